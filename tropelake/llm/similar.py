"""Most similar vectors for every vector.

Sun, Wang, Qin, Zhang and Lin, "SRS: solving c-approximate nearest neighbor queries in high dimensional Euclidean
space with a tiny index", VLDB 2014: 2-stable (Gaussian) projections keep distances up to a chi-square factor, so the
nearest neighbours are looked for in order of projected distance until a chi-square test says that a closer one is
unlikely.  A kd-tree orders the search; its upper part cuts the space into cells, one to a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import checkpointed, unit, vectors_of
from .top_n import top_n_per_group

LEAF, CHUNK = 128, 4096
#: Length of the second projection, which keeps most far pairs from being verified.
SKETCH = 24
#: Share of pairs that must pass the projected test before all pairs of a block are compared by one matrix product.
DENSE = 0.1
#: Least number of sampled rows for each cell.
CELL_SAMPLE = 64


def chi_square_quantile(p: float, m: int) -> float:
    """Of the chi-square distribution with an even number ``m`` of degrees of freedom, whose tail is a Poisson sum."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        tail = sum(math.exp(-x / 2 + k * math.log(x / 2 or 1e-300) - math.lgamma(k + 1)) for k in range(m // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


def projection(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class Cells:
    """The upper part of the kd-tree: medians of a sample, each level the same depth."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(1 << depth, int)
        self.cut = np.zeros(1 << depth)
        groups = {1: sample}
        for node in range(1, 1 << depth):
            rows = groups.pop(node)
            if len(rows):
                self.axis[node] = int(rows.std(axis=0).argmax())
                self.cut[node] = float(np.median(rows[:, self.axis[node]]))
            right = rows[:, self.axis[node]] > self.cut[node]
            groups[2 * node], groups[2 * node + 1] = rows[~right], rows[right]

    def visits(self, rows: np.ndarray, sigma: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell and whether it's the row's own, for all cells where a neighbour may lie with a probability of at least ``least``, when it differs by a normal step of the row's ``sigma`` on every axis."""
        row, node, chance = np.arange(len(rows)), np.ones(len(rows), int), np.ones(len(rows))
        own = np.ones(len(rows), bool)
        table = np.array([NormalDist().cdf(-x / 64) for x in range(64 * 6)] + [0.0])
        for _ in range(self.depth):
            gap = rows[row, self.axis[node]] - self.cut[node]
            right = gap > 0
            far = chance * table[np.minimum(np.abs(gap) / sigma[row] * 64, 384).astype(int)]
            go = far >= least
            row = np.concatenate([row, row[go]])
            own = np.concatenate([own, np.zeros(go.sum(), bool)])
            chance = np.concatenate([chance, far[go]])
            node = np.concatenate([2 * node + right, (2 * node + ~right)[go]])
        return row, node - (1 << self.depth), own


def kd_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which kd-tree leaves are stretches of rows, and where they start.  Rows equal in every axis keep their order."""
    order, todo, starts = np.arange(len(rows)), [(0, len(rows))] if len(rows) else [], []
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            starts.append(a)
            continue
        part = rows[order[a:b]]
        axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
        order[a:b] = order[a:b][np.argsort(part[:, axis], kind="stable")]
        todo += [((a + b) // 2, b), (a, (a + b) // 2)]
    return order, np.array(starts, int)


class Found:
    """The k nearest so far of each row: squared distances, ascending, and the neighbours' identifiers."""

    def __init__(self, n: int, k: int, bound: np.ndarray | float):
        self.square = np.repeat(np.broadcast_to(np.asarray(bound, float), n)[:, None], k, axis=1)
        self.who = np.full((n, k), -1, np.int64)

    def add(self, row: np.ndarray, who: np.ndarray, square: np.ndarray) -> None:
        if not len(row):
            return
        k = self.square.shape[1]
        rows = np.unique(row)
        slot = np.searchsorted(rows, row)
        old = np.repeat(np.arange(len(rows)), k)
        slot = np.concatenate([slot, old])
        who = np.concatenate([who, self.who[rows].ravel()])
        square = np.concatenate([square, self.square[rows].ravel()])
        order = np.lexsort((np.where(who < 0, np.iinfo(np.int64).max, who), np.round(square / 2, 9), slot))
        first = np.searchsorted(slot[order], np.arange(len(rows)))
        take = order[first[:, None] + np.arange(k)]
        self.square[rows], self.who[rows] = square[take], who[take]


class Points:
    """Rows of a cell in the order of their kd-tree, with its leaves' boxes, two projections and what was found for each."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, project: np.ndarray, sketch: np.ndarray, k: int, bound: np.ndarray | float):
        low = (rows @ project).astype(np.float32)
        order, self.starts = kd_order(low)
        low, self.ids, self.rows = low[order], ids[order], rows[order]
        self.ends = np.r_[self.starts[1:], len(ids)] if len(ids) else self.starts
        self.low = np.minimum.reduceat(low, self.starts) if len(ids) else low
        self.high = np.maximum.reduceat(low, self.starts) if len(ids) else low
        square, one = np.einsum("ij,ij->i", low, low)[:, None], np.ones((len(ids), 1), np.float32)
        self.left, self.right = np.hstack([low, square, one]), np.hstack([-2 * low, one, square])
        self.sketch, self.flat = (self.rows @ sketch).astype(np.float32), self.rows.astype(np.float32)
        self.silent = bool(np.isscalar(bound) and bound < 0)  # rows that are looked at, but ask for nothing
        self.found = Found(len(ids), k, bound if np.isscalar(bound) else bound[order])

    def reach(self) -> np.ndarray:
        """Of each leaf the largest k-th squared distance so far."""
        return np.maximum.reduceat(self.found.square[:, -1], self.starts)


def search(a: Points, b: Points, factor: float, sketch_factor: float, bound: float) -> None:
    """Nearest rows of ``b`` for those of ``a`` and the other way round; ``a`` may be ``b``.

    Each leaf of ``a`` takes the leaves of ``b`` in order of the distance between their boxes.  A pair is looked at
    when its projected squared distance is at most ``factor`` times the k-th squared distance so far of either row, and
    verified when a second, longer projection agrees; a pair of leaves is left out, and with that the search of their
    rows ends, when the boxes' distance passes that test for every row of both: the chi-square test.
    """
    if not len(a.starts) or not len(b.starts):
        return
    for leaf, (low, high) in enumerate(zip(a.low, a.high)):
        mine = slice(a.starts[leaf], a.ends[leaf])
        gap = np.maximum(0, np.maximum(b.low - high, low - b.high))
        box = np.einsum("ij,ij->i", gap, gap)
        left = np.argsort(box, kind="stable")
        if a is b:
            left = left[left >= leaf]
        chunk = 1024  # the first step is small, to get a bound
        while len(left):
            kth = a.found.square[mine, -1]
            left = left[box[left] <= factor * np.maximum(kth.max(), b.reach()[left]) + 1e-5]
            take = max(1, int(np.searchsorted(np.cumsum(b.ends[left] - b.starts[left]), chunk)))
            now, left, chunk = np.sort(left[:take]), left[take:], CHUNK
            if not len(now):
                break
            where = np.concatenate([np.arange(b.starts[x], b.ends[x]) for x in now])
            far = a.left[mine] @ b.right[where].T
            other = b.found.square[where, -1]
            if kth.min() >= bound or other.min() >= bound:  # nothing found yet that would part the rows
                hit = far <= factor * bound + 1e-5
            else:
                hit = (far <= factor * kth[:, None] + 1e-5) | (far <= factor * other + 1e-5)
            q, c = np.divmod(np.flatnonzero(hit.ravel()), hit.shape[1])
            q, c = q + a.starts[leaf], where[c]
            if a is b:
                q, c = q[q < c], c[q < c]
            if len(q) > DENSE * hit.size and len(where) > 256:  # many: all of them at once, by one product
                near = 2 - 2 * (a.flat[mine] @ b.flat[where].T)
                wanted = a.found.square[mine, -1:]
                k = a.found.square.shape[1]
                if b.silent and near.shape[1] > k + 1:  # only a's rows ask: the k nearest and the row itself bound each list
                    wanted = np.minimum(wanted, np.partition(near, k, axis=1)[:, k : k + 1])
                hit &= (near <= wanted + 1e-5) | (near <= b.found.square[where, -1] + 1e-5)
                q, c = np.divmod(np.flatnonzero(hit.ravel()), hit.shape[1])
                q, c = q + a.starts[leaf], where[c]
                if a is b:
                    q, c = q[q < c], c[q < c]
            for at in range(0, len(q), 65_536):
                _verify(a, b, q[at : at + 65_536], c[at : at + 65_536], sketch_factor)


def _verify(a: Points, b: Points, q: np.ndarray, c: np.ndarray, sketch_factor: float) -> None:
    most = np.maximum(a.found.square[q, -1], b.found.square[c, -1])
    step = a.sketch[q] - b.sketch[c]
    keep = np.einsum("ij,ij->i", step, step) <= sketch_factor * most + 1e-5
    q, c, most = q[keep], c[keep], most[keep]
    square = np.maximum(2 - 2 * np.einsum("ij,ij->i", a.rows[q], b.rows[c]), 0)
    keep = (square <= most + 1e-8) & (a.ids[q] != b.ids[c])
    q, c, square = q[keep], c[keep], square[keep]
    a.found.add(q, b.ids[c], square)
    if not b.silent:
        b.found.add(c, a.ids[q], square)


def _sample(dim: int, project: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors_of(batch.column("emb"), dim)[1]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in (unit(rows) @ project).astype(np.float32)], pa.binary())], names=["p"])

    return run


def _keyed(dim: int):
    """Usable vectors as unit vectors, with a hash of their direction's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.random.default_rng(1).integers(1, 1 << 63, dim, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            at, rows = vectors_of(batch.column("emb"), dim)
            if not len(at):
                continue
            bits = (rows + np.float32(0)).view(np.uint32).astype(np.uint64)
            bits ^= bits >> np.uint64(7)
            key = ((bits * np.uint64(0x9E3779B97F4A7C15) ^ (bits << np.uint64(29))) * power).sum(axis=1)
            key ^= key >> np.uint64(31)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)).cast(pa.int64()), pa.array(key.view(np.int64)), pa.array([x.tobytes() for x in rows], pa.binary())], names=["id", "key", "vec"])

    return run


def _route(dim: int, project: np.ndarray, cells: Cells, sigma: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float32).reshape(-1, dim)
            row, cell, own = cells.visits(unit(rows) @ project, np.full(len(rows), sigma), least)
            home = np.zeros(len(rows), int)
            home[row[own]] = cell[own]
            keep = own | ((cell > home[row]) == ((cell + home[row]) % 2 == 0))  # of two cells, the rows of one visit the other
            row, cell, own = row[keep], cell[keep], own[keep]
            for at in range(0, len(row), 8192):
                take = pa.array(row[at : at + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + 8192].astype(np.int32)), pa.array(own[at : at + 8192]), batch.column("id").take(take), batch.column("vec").take(take)], names=["cell", "own", "id", "vec"])

    return run


def _search_cell(dim: int, k: int, project: np.ndarray, sketch: np.ndarray, factor: float, sketch_factor: float, bound: float):
    """Rows of one partition hold whole cells, sorted by cell and identifier."""

    def cell(ids: np.ndarray, own: np.ndarray, vec: np.ndarray) -> Iterator[pa.RecordBatch]:
        wide = unit(vec)
        home, guests = (Points(ids[m], wide[m], project, sketch, k, bound) for m in (own, ~own))
        search(home, home, factor, sketch_factor, bound)
        search(guests, home, factor, sketch_factor, bound)
        for p in (home, guests):
            r, c = np.nonzero(p.found.who >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(p.ids[r]), pa.array(p.found.who[r, c]), pa.array(1 - p.found.square[r, c] / 2)], names=["id", "other", "similarity"])

    return _cells_of(cell, ("id", "own"), dim)


def _cells_of(cell: Callable, columns: tuple[str, ...], dim: int):
    """Calls ``cell`` with the columns and the vectors of each whole cell of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column("cell").to_numpy()
            change = np.flatnonzero(number[1:] != number[:-1]) + 1
            for part in np.split(np.arange(len(number)), change):
                if number[part[0]] != now and held:
                    yield from cell(*map(np.concatenate, zip(*held)))
                    held = []
                now = number[part[0]]
                rows = batch.slice(part[0], len(part))
                vec = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float32).reshape(-1, dim)
                held.append((*[rows.column(c).to_numpy(zero_copy_only=False) for c in columns], vec))
        if held:
            yield from cell(*map(np.concatenate, zip(*held)))

    return run


def most_similar(df: DataFrame, ident: str, emb: str, dim: int, k: int = 5, min_similarity: float = 0.95, m: int = 12, certainty: float = 0.99, route_least: float = 0.002, cell_rows: int = 12_500, sample_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """For every record the ``k`` others with the largest cosine of at least ``min_similarity``: ``ident``, ``other``, ``similarity``, ``rank``.

    1. Records with the same vector become one class, named by its smallest identifier (a partial aggregation, so a
       third of all rows may be copies).  Repeated rows of an identifier fall together there.
    2. ``m`` Gaussian projections of a sample of about ``sample_rows`` rows, and of at least 64 for each cell, give the
       upper part of a kd-tree, with a cell for about ``cell_rows`` classes.  Every class goes to its own cell and visits those where a neighbour at
       ``min_similarity`` lies with a probability of at least ``route_least``; of two cells only one's rows visit the other.
    3. In a cell the search runs leaf by leaf in order of projected distance until the chi-square test of certainty
       ``certainty`` holds for the k-th neighbour so far.
    4. Lists of different cells are joined and classes replaced by their members.

    A neighbour at exactly ``min_similarity`` is missed with a probability of about 1 - ``certainty`` plus what the
    routing leaves out, a closer one far less often; nothing found is wrong.  Similarities within 1e-9 are equal
    and then the smaller identifier comes first.  ``ident`` must be an integer column; rows with a null identifier and
    vectors that are null, not of ``dim`` values, not finite or all zero have no part.  An empty table gives no rows.
    """
    project, sketch, bound = projection(dim, m, seed), projection(dim, SKETCH, seed + 1), 2 - 2 * min_similarity
    factor, sketch_factor = chi_square_quantile(certainty, m), chi_square_quantile(0.999, SKETCH)
    rows = _rows(df, ident, emb)
    members = _members(rows, dim)
    cells = _fit(members, rows, project, dim, cell_rows, sample_rows, seed)
    keyed = rows.mapInArrow(_keyed(dim), "id BIGINT, key BIGINT, vec BINARY")
    classes = keyed.groupBy("key").agg(F.min(F.struct("id", "vec")).alias("r")).select("r.id", "r.vec")
    routed = classes.mapInArrow(_route(dim, project, cells, math.sqrt(bound), route_least), "cell INT, own BOOLEAN, id BIGINT, vec BINARY")
    near = _by_cell(routed, cells).mapInArrow(_search_cell(dim, k, project, sketch, factor, sketch_factor, bound), "id BIGINT, other BIGINT, similarity DOUBLE")
    return _of_members(near, members, ident, k)


def most_similar_to(df: DataFrame, ident: str, emb: str, dim: int, asked: Callable[[Column], Column], k: int = 5, m: int = 12, certainty: float = 0.95, route_least: float = 0.01, cell_rows: int = 12_500, sample_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """The ``k`` others with the largest cosine, however small, for the records whose identifier is ``asked`` for: ``ident``, ``other``, ``similarity``, ``rank``.

    The search of ``most_similar`` in two rounds.  First every record that is asked for searches its own cell, which gives
    a bound for its k-th neighbour; then it visits the cells in which a closer one lies with a chance of at least
    ``route_least``.  All records stay in their cells; only those asked for travel, to as many cells as their bounds
    demand.  Rows, ties and copies are treated as there; a record has fewer than ``k`` neighbours only if there are no more.
    """
    project, sketch = projection(dim, m, seed), projection(dim, SKETCH, seed + 1)
    factor, sketch_factor = chi_square_quantile(certainty, m), chi_square_quantile(0.999, SKETCH)
    rows = _rows(df, ident, emb)
    members = _members(rows, dim)
    cells = _fit(members, rows, project, dim, cell_rows, sample_rows, seed)
    keyed = rows.mapInArrow(_keyed(dim), "id BIGINT, key BIGINT, vec BINARY")
    classes = keyed.groupBy("key").agg(F.min(F.struct("id", "vec")).alias("r"), F.max(asked(F.col("id"))).alias("asks")).select("r.id", "r.vec", "asks")
    homes = checkpointed(classes.mapInArrow(_home(dim, project, cells), "cell INT, id BIGINT, vec BINARY, asks BOOLEAN"))
    lists = "id BIGINT, other BIGINT, similarity DOUBLE"
    visit = lambda guests: _visit_cell(dim, k, project, sketch, factor, sketch_factor, guests)
    first = checkpointed(_by_cell(homes.withColumns({"own": F.lit(True), "bound": F.lit(4.0)}), cells).mapInArrow(visit(False), lists))
    bounds = first.groupBy("id").agg(F.when(F.count("*") >= k, F.max(2 - 2 * F.col("similarity"))).otherwise(4.0).alias("bound"))
    guests = homes.where("asks").join(bounds, "id", "left").select("id", "vec", F.coalesce("bound", F.lit(4.0)).alias("bound"))
    guests = guests.mapInArrow(_send(dim, project, cells, route_least), "cell INT, id BIGINT, vec BINARY, bound DOUBLE")
    both = homes.select("cell", F.lit(True).alias("own"), "id", "vec", F.lit(False).alias("asks"), F.lit(4.0).alias("bound"))
    both = both.unionByName(guests.select("cell", F.lit(False).alias("own"), "id", "vec", F.lit(True).alias("asks"), "bound"))
    second = _by_cell(both, cells).mapInArrow(visit(True), lists)
    return _of_members(first.unionByName(second), members, ident, k).where(asked(F.col(ident)))


def _rows(df: DataFrame, ident: str, emb: str) -> DataFrame:
    return df.where(F.col(f"`{ident}`").isNotNull()).select(F.col(f"`{ident}`").alias("id"), F.col(f"`{emb}`").alias("emb"))


def _members(rows: DataFrame, dim: int) -> DataFrame:
    """``id`` and ``key`` of all usable records, once each."""
    return checkpointed(rows.mapInArrow(_keys_only(dim), "id BIGINT, key BIGINT").distinct())


def _fit(members: DataFrame, rows: DataFrame, project: np.ndarray, dim: int, cell_rows: int, sample_rows: int, seed: int) -> Cells:
    """Cells from a sample; how many there are follows from the number of all.

    The sample has about ``sample_rows`` rows, but at least ``CELL_SAMPLE`` for each cell, so cells keep their size however
    many there are; the driver holds 48 bytes of each.
    """
    if project.shape[1] % 2:
        raise ValueError("m must be even")
    total = members.count()
    depth = max(0, math.ceil(math.log2(max(1, total / cell_rows))))
    wanted = max(sample_rows, CELL_SAMPLE << depth)
    drawn = rows.select("emb").sample(min(1.0, wanted / max(1, total)), seed).mapInArrow(_sample(dim, project), "p BINARY").toPandas()["p"]
    return Cells(np.frombuffer(b"".join(drawn), np.float32).reshape(-1, project.shape[1]).astype(float), depth)


def _by_cell(routed: DataFrame, cells: Cells) -> DataFrame:
    """One partition for each cell, sorted by identifier."""
    return routed.repartitionById(1 << cells.depth, F.col("cell")).sortWithinPartitions("cell", "id")


def _of_members(near: DataFrame, members: DataFrame, ident: str, k: int) -> DataFrame:
    """Lists of classes as lists of their members: own copies first by similarity 1, then the first members of near classes."""
    named = members.groupBy("key").agg(F.min("id").alias("cls"), F.count("*").alias("n"))
    copies = members.join(named.where("n > 1"), "key").select("cls", "id", "n")
    by_class = Window.partitionBy("cls").orderBy("id")
    few = copies.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1).select("cls", "id")
    wide = near.join(few.withColumnsRenamed({"cls": "other", "id": "member"}), "other", "left").select("id", F.coalesce("member", "other").alias("other"), "similarity")
    lists = wide.unionByName(few.select(F.col("cls").alias("id"), F.col("id").alias("other"), F.lit(1.0).alias("similarity")))
    expanded = lists.join(copies.select(F.col("cls").alias("id"), F.col("id").alias("member")), "id", "left").select(F.coalesce("member", "id").alias("id"), "other", "similarity").where("id <> other")
    best = expanded.select("id", "other", F.round("similarity", 9).alias("similarity")).groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    return top_n_per_group(best, "id", "similarity", "other", k, descending=True).select(F.col("id").alias(ident), "other", "similarity", "rank")


def _home(dim: int, project: np.ndarray, cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float32).reshape(-1, dim)
                row, cell, own = cells.visits(unit(rows) @ project, np.ones(len(rows)), 2.0)
                home = np.zeros(len(rows), np.int32)
                home[row[own]] = cell[own]
                yield pa.RecordBatch.from_arrays([pa.array(home), batch.column("id"), batch.column("vec"), batch.column("asks")], names=["cell", "id", "vec", "asks"])

    return run


def _send(dim: int, project: np.ndarray, cells: Cells, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float32).reshape(-1, dim)
                sigma = np.sqrt(np.maximum(batch.column("bound").to_numpy(), 1e-12))
                row, cell, own = cells.visits(unit(rows) @ project, sigma, least)
                for part in np.array_split(np.flatnonzero(~own), max(1, len(row) // 8192)):
                    take = pa.array(row[part])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[part].astype(np.int32)), *[batch.column(c).take(take) for c in ("id", "vec", "bound")]], names=["cell", "id", "vec", "bound"])

    return run


def _visit_cell(dim: int, k: int, project: np.ndarray, sketch: np.ndarray, factor: float, sketch_factor: float, guests: bool):
    """Neighbours in one cell for the records that ask: its own, or only its guests."""

    def cell(ids: np.ndarray, own: np.ndarray, asks: np.ndarray, bound: np.ndarray, vec: np.ndarray) -> Iterator[pa.RecordBatch]:
        wide = unit(vec)
        here = asks & (~own if guests else own)
        if here.any() and own.any():
            stored = Points(ids[own], wide[own], project, sketch, k, -1.0)
            asking = Points(ids[here], wide[here], project, sketch, k, bound[here])
            search(asking, stored, factor, sketch_factor, 4.0)
            r, c = np.nonzero(asking.found.who >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(asking.ids[r]), pa.array(asking.found.who[r, c]), pa.array(1 - asking.found.square[r, c] / 2)], names=["id", "other", "similarity"])

    return _cells_of(cell, ("id", "own", "asks", "bound"), dim)


def _keys_only(dim: int):
    whole = _keyed(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches):
            yield batch.select(["id", "key"])

    return run
