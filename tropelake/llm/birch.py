"""Grouping records into similarity clusters with cluster-feature trees.

Zhang, Ramakrishnan and Livny, "BIRCH", SIGMOD 1996, on unit vectors: a cluster feature is a count and a vector sum,
so features add up and trees of different partitions merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import checkpointed, unit, vectors_of
from .top_n import top_n_per_group

LEAF, BRANCH = 64, 16
#: Most random planes that cut a combination's entries into cells.
MOST_BITS = 12


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T


class _Node:
    """Counts and sums of its entries; an inner node has one child to each entry."""

    def __init__(self, weight: np.ndarray, sums: np.ndarray, kids: list | None = None):
        self.weight, self.sums, self.kids = weight, sums, kids

    def halves(self) -> list[_Node]:
        near = _cosines(self.sums, self.sums)
        a = int(near.sum(axis=1).argmin())
        b = int(near[a].argmin())
        left = near[a] >= near[b]
        if left.all() or not left.any():
            left = np.arange(len(left)) < len(left) // 2
        return [_Node(self.weight[m], self.sums[m], [k for k, x in zip(self.kids, m) if x] if self.kids else None) for m in (left, ~left)]

    def parts(self) -> list[_Node]:
        """Itself, or what it splits into when it is over its size."""
        if len(self.weight) <= (BRANCH if self.kids else LEAF):
            return [self]
        return [x for half in self.halves() for x in half.parts()]

    def add(self, weight: np.ndarray, sums: np.ndarray, least: float) -> list[_Node]:
        if self.kids is None:
            while len(weight):
                if len(self.weight):
                    near = _cosines(sums, self.sums)
                    best = near.argmax(axis=1)
                    fits = near[np.arange(len(best)), best] >= least
                    np.add.at(self.weight, best[fits], weight[fits])
                    np.add.at(self.sums, best[fits], sums[fits])
                    weight, sums = weight[~fits], sums[~fits]
                if len(weight):
                    self.weight, self.sums = np.append(self.weight, weight[:1]), np.vstack([self.sums, sums[:1]])
                    weight, sums = weight[1:], sums[1:]
        else:
            best = _cosines(sums, self.sums).argmax(axis=1)
            kids = []
            for i, kid in enumerate(self.kids):
                mine = best == i
                kids += kid.add(weight[mine], sums[mine], least) if mine.any() else [kid]
            self.kids = kids
            self.weight = np.array([k.weight.sum() for k in kids])
            self.sums = np.array([k.sums.sum(axis=0) for k in kids])
        return self.parts()

    def leaves(self) -> list[_Node]:
        return [self] if self.kids is None else [x for k in self.kids for x in k.leaves()]


class Tree:
    """A cluster-feature tree.  An entry takes in what has a cosine of at least ``least`` to its mean."""

    def __init__(self, dim: int, least: float):
        self.least, self.size = least, 0
        self.root = _Node(np.zeros(0), np.zeros((0, dim)))

    def add(self, weight: np.ndarray, sums: np.ndarray) -> None:
        for at in range(0, len(weight), 4096):
            parts = self.root.add(weight[at : at + 4096], sums[at : at + 4096], self.least)
            while len(parts) > 1:
                top = _Node(np.array([p.weight.sum() for p in parts]), np.array([p.sums.sum(axis=0) for p in parts]), parts)
                parts = top.parts()
            self.root = parts[0]
        self.size = sum(len(x.weight) for x in self.root.leaves())

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        leaves = self.root.leaves()
        return np.concatenate([x.weight for x in leaves]), np.vstack([x.sums for x in leaves])


def ward(weight: np.ndarray, sums: np.ndarray, least: float) -> np.ndarray:
    """Cluster numbers from Ward agglomeration of cluster features: always the pair whose union adds least to the sum of squares, among pairs whose means have a cosine of at least ``least``."""
    label = np.arange(len(weight))
    if len(weight) < 2:
        return label
    norm = (sums / np.linalg.norm(sums, axis=1, keepdims=True)).astype(np.float32)
    close = np.zeros(len(weight), bool)  # the rest has no partner to begin with, but may be met by a mean that moves
    for at in range(0, len(weight), 1024):
        near = norm[at : at + 1024] @ norm.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -1
        close[at : at + 1024] = (near >= least - 1e-5).any(axis=1)
    pick = np.flatnonzero(close)
    w, s = weight[pick].astype(float), sums[pick].copy()
    owner = pick.copy()
    alive = np.ones(len(pick), bool)

    def costs(i: int) -> np.ndarray:
        mean = s / w[:, None]
        gap = ((mean - mean[i]) ** 2).sum(axis=1) * w * w[i] / (w + w[i])
        cosine = (s @ s[i]) / (np.linalg.norm(s, axis=1) * np.linalg.norm(s[i]))
        gap[~alive | (cosine < least)] = np.inf
        gap[i] = np.inf
        return gap

    best = np.full(len(pick), np.inf)
    mate = np.zeros(len(pick), int)
    for i in range(len(pick)):
        c = costs(i)
        mate[i] = c.argmin()
        best[i] = c[mate[i]]
    while len(pick):
        a = int(best.argmin())
        if not np.isfinite(best[a]):
            break
        b = int(mate[a])
        w[a] += w[b]
        s[a] += s[b]
        alive[b], best[b] = False, np.inf
        label[label == owner[b]] = owner[a]
        c = costs(a)
        mate[a], best[a] = c.argmin(), c.min()
        better = c < best
        better[a] = False
        mate[better], best[better] = a, c[better]
        for i in np.flatnonzero(alive & np.isin(mate, (a, b)) & ~better):  # their mate changed
            if i != a:
                x = costs(i)
                mate[i], best[i] = x.argmin(), x.min()
    return label


FEATURE = "key STRING, weight DOUBLE, sums BINARY"
TILE = 512


def _rows(key: str, weight: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(weight), 8192):
        part = sums[at : at + 8192]
        yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(part), pa.string()), "weight": pa.array(weight[at : at + 8192]), "sums": pa.array([x.tobytes() for x in part], pa.binary())})


def _sums(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, dim)


def _summary(dim: int, least: float, most: int):
    """Of each partition's vectors, the leaf entries of trees for every combination of features.

    When the trees hold more than ``most`` entries, the largest is passed on and begun anew.  Entries add up, so nothing
    is lost by that, and no threshold moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Tree] = {}
        total = 0
        for batch in batches:
            at, rows = vectors_of(batch.column("emb"), dim)
            if not len(at):
                continue
            rows = unit(rows)
            keys = batch.column("key").take(pa.array(at)).to_pandas()
            for key, where in keys.groupby(keys, sort=False).indices.items():
                tree = trees.setdefault(key, Tree(dim, least))
                total -= tree.size
                tree.add(np.ones(len(where)), rows[where])
                total += tree.size
                while total > most:
                    large = max(trees, key=lambda k: trees[k].size)
                    full = trees.pop(large)
                    total -= full.size
                    yield from _rows(large, *full.entries())
        for key, tree in trees.items():
            yield from _rows(key, *tree.entries())

    return run


def _cells(dim: int, bits: dict[str, int], seed: int):
    """Entries of a combination that has many, by the sides of ``bits`` random planes on which their means lie; others in cell 0."""
    planes = np.random.default_rng(seed).standard_normal((dim, max(bits.values(), default=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                side = _sums(batch.column("sums"), dim) @ planes > 0
                used = np.array([bits.get(k, 0) for k in batch.column("key").to_pylist()])
                place = np.arange(side.shape[1])
                cell = ((side & (place < used[:, None])) << place).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


def _merge(dim: int, least: float, join: float, most: int):
    """Entries of one combination and cell through one tree, its leaves agglomerated; rows arrive sorted by both, so one tree is held."""

    def out(key: str, tree: Tree) -> Iterator[pa.RecordBatch]:
        weight, sums = tree.entries()
        tops, label = np.unique(ward(weight, sums, join), return_inverse=True)
        total = np.zeros((len(tops), dim))
        np.add.at(total, label, sums)
        yield from _rows(key, np.bincount(label, weights=weight), total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, cell = batch.column("key").to_pandas().to_numpy(), batch.column("cell").to_numpy()
            weight, sums = batch.column("weight").to_numpy(), _sums(batch.column("sums"), dim)
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (cell[1:] != cell[:-1])) + 1
            for part in np.split(np.arange(len(keys)), change):
                now = (keys[part[0]], int(cell[part[0]]))
                if now != held or tree.size > most:
                    if tree is not None:
                        yield from out(held[0], tree)
                    held, tree = now, Tree(dim, least)
                tree.add(weight[part], sums[part])
        if tree is not None:
            yield from out(held[0], tree)

    return run


def _reduced(entries: DataFrame, dim: int, least: float, join: float, cell_entries: int, max_rounds: int, seed: int) -> tuple[DataFrame, bool]:
    """The entries merged, and whether every combination was merged in one place in the end.

    A combination of at most ``cell_entries`` entries is merged by one task.  One of more is cut into cells by random
    planes, others in every round, so the parts of a cluster that lie in different cells meet in a later round.
    """
    for turn in range(max_rounds):
        many = entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell_entries).collect()
        bits = {r.key: min(MOST_BITS, math.ceil(math.log2(r.n / cell_entries))) for r in many}
        placed = entries.mapInArrow(_cells(dim, bits, seed + turn), FEATURE + ", cell INT").repartition("key", "cell").sortWithinPartitions("key", "cell", F.desc("weight"), "sums")
        entries = placed.mapInArrow(_merge(dim, least, join, 4 * cell_entries), FEATURE)
        if not bits:
            return entries, True
        entries = checkpointed(entries)
    return entries, False


def _codes(features: list[tuple]) -> tuple[list[dict], np.ndarray]:
    """Numbers for the values of each feature, 0 for null."""
    width = len(features[0]) if features else 0
    names = [{v: i + 1 for i, v in enumerate(dict.fromkeys(f[j] for f in features if f[j] is not None))} for j in range(width)]
    return names, np.array([[c.get(x, 0) for c, x in zip(names, f)] for f in features], np.int32).reshape(len(features), width)


def _agree(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    return ((own == 0) | (others == 0) | (own == others)).all(axis=1)


def _parts(key: str) -> tuple:
    return tuple(None if x == "" else x[1:] for x in key.split("\x1f"))


def _across(found: list, dim: int, least: float) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Joins candidates of agreeing combinations of features, fullest combinations and heaviest candidates first: features, weights and sums."""
    parts = [(_parts(r.key), r.weight, np.frombuffer(bytes(r.sums), float)) for r in found]
    parts.sort(key=lambda p: (sum(x is None for x in p[0]), -p[1], [x or "" for x in p[0]], p[2].tobytes()))
    _, codes = _codes([p[0] for p in parts])
    feats: list[tuple] = []
    own, weights = np.zeros_like(codes), np.zeros(len(parts))
    sums, mean = np.zeros((len(parts), dim)), np.zeros((len(parts), dim), np.float32)
    for code, (feat, weight, total) in zip(codes, parts):
        n, best = len(feats), -1
        if n:
            near = np.where(_agree(code, own[:n]), mean[:n] @ (total / np.linalg.norm(total)).astype(np.float32), -2)
            best = int(near.argmax()) if near.max() >= least else -1
        if best < 0:
            best = n
            feats.append(feat)
            own[n] = code
        else:
            feats[best] = tuple(x if y is None else y for x, y in zip(feat, feats[best]))
            own[best] = np.where(own[best] == 0, code, own[best])
        weights[best] += weight
        sums[best] += total
        mean[best] = sums[best] / np.linalg.norm(sums[best])
    return feats, weights[: len(feats)], sums[: len(feats)]


class _Nearest:
    """The closest agreeing centre of rows, by tiles of centres, among those whose features agree with a row's."""

    def __init__(self, feats: list[tuple], centres: np.ndarray):
        self.names, self.own = _codes(feats)
        self.centres = centres / np.linalg.norm(centres, axis=1, keepdims=True)
        self.flat = self.centres.astype(np.float32)
        self.known: dict[str, np.ndarray] = {}

    def agreeing(self, key: str) -> np.ndarray:
        if key not in self.known:
            if len(self.known) > 1024:
                self.known.clear()
            code = np.array([0 if v is None else c.get(v, -1) for c, v in zip(self.names, _parts(key))])
            self.known[key] = np.flatnonzero(_agree(code, self.own))
        return self.known[key]

    def of(self, rows: np.ndarray, keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Centre (-1 without any) and cosine of each row of unit vectors."""
        best, value = np.full(len(rows), -1, np.int32), np.full(len(rows), -2.0)
        narrow = rows.astype(np.float32)
        for key, where in keys.groupby(keys, sort=False).indices.items():
            mine, top = self.agreeing(key), np.full(len(where), -2, np.float32)
            for at in range(0, len(mine), TILE):
                near = narrow[where] @ self.flat[mine[at : at + TILE]].T
                here = near.argmax(axis=1)
                high = near[np.arange(len(here)), here]
                better = high > top
                best[where[better]] = mine[at + here[better]]
                top[better] = high[better]
        some = best >= 0
        value[some] = np.einsum("ij,ij->i", rows[some], self.centres[best[some]])
        return best, value


def _gather(dim: int, feats: list[tuple], centres: np.ndarray, least: float):
    """Sums of the entries that each centre takes, one row for each centre and partition."""
    near = _Nearest(feats, centres) if feats else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows and near:
                sums = _sums(batch.column("sums"), dim)
                best, value = near.of(sums / np.linalg.norm(sums, axis=1, keepdims=True), batch.column("key").to_pandas())
                for c, s in zip(best[value >= least].tolist(), sums[value >= least]):
                    total[c] = total[c] + s if c in total else s
        if total:
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(list(total), pa.int32()), "sums": pa.array([s.tobytes() for s in total.values()], pa.binary())})

    return run


def _add_up(dim: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.frombuffer(b"".join(pdf["sums"]), float).reshape(-1, dim).sum(axis=0)
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[:1], "sums": [whole.tobytes()]})

    return run


def _assign(dim: int, feats: list[tuple], centres: np.ndarray, least: float):
    """Each record's best agreeing centre and the cosine to it, where that is at least ``least``."""
    near = _Nearest(feats, centres) if feats else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = vectors_of(batch.column("emb"), dim)
            if len(at) and near:
                best, value = near.of(unit(rows), batch.column("key").take(pa.array(at)).to_pandas())
                keep = value >= least
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at[keep])), pa.array(best[keep]), pa.array(value[keep])], names=["id", "cluster", "similarity"])

    return run


def label_of(column: Column) -> Column:
    """A feature label without a colon and what follows, outer blanks and case."""
    return F.lower(F.btrim(F.substring_index(column, ":", 1), F.lit(" \t\n\r")))


def cluster_members(df: DataFrame, ident: str, emb: str, features: list[Column], dim: int, min_members: int = 10, absorb: float = 0.6, join: float = 0.65, member: float = 0.65, max_entries: int = 50_000, cell_entries: int = 8192, max_rounds: int = 8, max_candidates: int = 20_000, seed: int = 5) -> DataFrame:
    """Clusters of at least ``min_members`` similar records whose features agree: columns ``ident``, ``cluster``, ``similarity``, ``first``, ``size``.

    1. Every partition builds a cluster-feature tree for each combination of features (``absorb``: least cosine
       of a record to the mean of the entry that takes it in).  Vectors are not shuffled, only leaf entries are: few for
       each cluster, combination and partition, and one for each record that is like no other.  A partition holds at
       most ``max_entries`` of them; what is more is passed on before its end, at the same threshold.
    2. The entries of a combination are merged in a tree and by Ward agglomeration (``join``: least cosine of the two
       means).  Combinations of over ``cell_entries`` entries are cut into cells by up to 12 random planes and merged in
       up to ``max_rounds`` rounds with other planes each, so no task holds an unbounded combination.
    3. What stands for enough records is a candidate.  Of a cluster of ``min_members`` records with f features, each
       null or not, some combination has at least u = min_members / 2^f (rounded up); combinations with fewer drop out, so
       at least min_members - (2^f - 1) (u - 1) remain.  Where a combination was still in cells in the last round, two
       records that met are enough.  Candidates of combinations that agree, where a null feature differs from nothing,
       are joined on the driver; over ``max_candidates`` of them an error says so.
    4. Every entry adds to the closest agreeing candidate with a cosine of at least ``member``; that gives the centres.
    5. One pass over all records assigns each to the closest agreeing centre with a cosine of at least ``member``, by
       tiles of centres.

    A cluster comes out whole or not at all, for step 5 looks at all records.  Without cells every cluster comes out.  With
    b planes two records at cosine s meet in a round with a chance of (1 - arccos(s) / pi)^b; of 10 records at 0.64 to each
    other none meet in 8 rounds of 8 planes with a chance under 1e-11, of 12 planes under 0.1 percent.

    ``features`` are columns, compared as they are.  A record whose vector is null, not of ``dim`` values, not
    finite or all zero belongs to no cluster, nor does one with a null identifier.  Repeated rows of an identifier
    count once in sizes.  ``first`` is the cluster's smallest identifier; ``cluster`` is a number without meaning.
    An empty table gives no rows.
    """
    key = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), f), F.lit("")) for f in features])
    rows = df.where(F.col(f"`{ident}`").isNotNull()).select(F.col(f"`{ident}`").alias("id"), F.col(f"`{emb}`").alias("emb"), key.alias("key"))
    entries = checkpointed(rows.select("key", "emb").mapInArrow(_summary(dim, absorb, max_entries), FEATURE))
    merged, whole = _reduced(entries, dim, absorb, join, cell_entries, max_rounds, seed)
    share = -(-min_members // 2 ** len(features))
    enough, total = (share, max(share, min_members - (2 ** len(features) - 1) * (share - 1))) if whole else (min(2, share),) * 2
    found = merged.where(F.col("weight") >= enough).take(max_candidates + 1)
    if len(found) > max_candidates:
        raise ValueError(f"more than {max_candidates} candidate clusters; raise max_candidates")
    feats, weights, sums = _across(found, dim, join)
    feats, sums = [f for f, w in zip(feats, weights) if w >= total], sums[weights >= total]
    taken = entries.mapInArrow(_gather(dim, feats, sums, member), "cluster INT, sums BINARY").groupBy("cluster").applyInPandas(_add_up(dim), "cluster INT, sums BINARY")
    centres = sums.copy()
    for r in taken.collect():  # at most a row for each candidate
        centres[r.cluster] = np.frombuffer(bytes(r.sums), float)
    id_type = rows.schema["id"].dataType
    assigned = rows.mapInArrow(_assign(dim, feats, centres, member), f"id {id_type.simpleString()}, cluster INT, similarity DOUBLE")
    once = assigned.groupBy("id").agg(F.max(F.struct("similarity", "cluster")).alias("best")).select("id", "best.cluster", "best.similarity")
    once = checkpointed(once)
    sizes = once.groupBy("cluster").agg(F.min("id").alias("first"), F.count("*").alias("size")).where(F.col("size") >= min_members)
    return once.join(F.broadcast(sizes), "cluster").select(F.col("id").alias(ident), "cluster", "similarity", "first", "size")  # sizes: at most max_candidates rows


def cluster_report(members: DataFrame, ident: str, typical: int = 5) -> DataFrame:
    """One row per cluster of ``cluster_members``: ``first``, ``size`` and ``typical``, its records nearest to the centre in that order."""
    nearest = top_n_per_group(members, "first", "similarity", ident, typical, descending=True)
    lists = nearest.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("rank", ident))).alias("t"))
    sizes = members.groupBy("first").agg(F.max("size").alias("size"))
    return sizes.join(lists, "first").select("first", "size", F.col(f"t.{ident}").alias("typical"))
