"""Long spans shared between records: k-mer seeds, collinear chains of matches, alignment of the gaps.

Seeds are minimizers (Roberts et al. 2004; "winnowing", Schleimer et al., SIGMOD 2003): every window of ``min_span``
characters picks one of its k-mers by a hash, so equal windows pick equal seeds.  Chains are found with a segment tree
over match ends (Abouelhoda and Ohlebusch, "Chaining algorithms for multiple genome comparison", 2005).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import checkpointed

#: Odd multiplier of the polynomial hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Characters that are hashed at once, and the bits of a place among them.
BLOCK, PLACE_BITS = 1 << 16, 16
#: Seeds that are looked at together before they are sent on.
GROUP = 1 << 18
#: How many of the next shared seeds are looked at to find records that share neighbouring spans.
FOLLOWERS = 4


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any stretches of a block of text, from prefix sums; equal stretches have equal hashes wherever they stand."""

    def __init__(self):
        self.table = _mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(BASE))
        self.up = np.cumprod(np.r_[np.uint64(1), np.full(BLOCK, BASE, np.uint64)], dtype=np.uint64)
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(BLOCK, INVERSE, np.uint64)], dtype=np.uint64)
        self.size, self.prefix = 0, np.zeros(BLOCK + 1, np.uint64)

    def read(self, text: str) -> None:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = len(code)
        rare = code >= 1 << 16
        value = self.table[np.where(rare, 0, code)] if rare.any() else self.table[code]
        if rare.any():
            value[rare] = _mix(code[rare].astype(np.uint64) + np.uint64(BASE))
        np.cumsum(value * self.up[: self.size], out=self.prefix[1 : self.size + 1])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[start]) * self.down[start])

    def raw(self, k: int) -> np.ndarray:
        """Unmixed hashes of all stretches of ``k`` characters; their high bits depend on every character."""
        n = self.size - k + 1
        return (self.prefix[k : k + n] - self.prefix[:n]) * self.down[:n]

    def all(self, k: int) -> np.ndarray:
        return _mix(self.raw(k))


def segments(texts: Iterable[str], span: int) -> Iterator[tuple[int, int, str]]:
    """Texts as (number, start, piece) of at most ``BLOCK`` characters; every window of ``span`` characters is in one piece."""
    for number, text in enumerate(texts):
        if len(text) <= BLOCK:
            yield number, 0, text
        else:
            for start in range(0, len(text) - span + 1, BLOCK - span + 1):
                yield number, start, text[start : start + BLOCK]


def blocks(pieces: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Pieces, whose text comes last, put together to at most ``BLOCK`` characters."""
    held, size = [], 0
    for piece in pieces:
        if held and size + len(piece[-1]) > BLOCK:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece[-1])
    if held:
        yield held


def inside(lengths: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces that stand one after the other: where they start, and the place and the piece of every window that lies in one."""
    offset = np.cumsum(lengths) - lengths
    count = lengths - span + 1
    piece = np.repeat(np.arange(len(lengths)), count)
    return offset, np.arange(count.sum()) + np.repeat(offset - (np.cumsum(count) - count), count), piece


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours, from minima of 2, 4, 8 … neighbours."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def minimizer_runs(hasher: Hasher, texts: list[str], span: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows that pick one seed, in texts of at least ``span`` characters, all hashed as one block: text, seed, run, first window, last window.

    A window picks its k-mer with the least 16 bits of hash, of equal ones the first.  ``run`` is a hash of all the run's
    characters and of the seed's place in them.
    """
    offset, window, piece = inside(np.array([len(t) for t in texts]), span)
    hasher.read("".join(texts))
    raw = hasher.raw(k)
    order = ((raw >> np.uint64(48)).astype(np.uint32) << np.uint32(PLACE_BITS)) | np.arange(len(raw), dtype=np.uint32)
    pick = (sliding_min(order, span - k + 1) & np.uint32((1 << PLACE_BITS) - 1))[window]
    new = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (piece[1:] != piece[:-1])])
    first, last, at, text = window[new], window[np.r_[new[1:] - 1, len(window) - 1]], pick[new].astype(np.int64), piece[new]
    run = hasher.of(first, last + span) ^ _mix((at - first).astype(np.uint64) * np.uint64(BASE))
    return text, _mix(raw[at]), run, first - offset[text], last - offset[text]


def _seeds(span: int, k: int):
    """Rows of runs, and with each row how to find out whether its seed stands in several records.

    Where two records of a group share a seed, that is known (``known``); then one row goes where the seed's other rows
    go (``at``), to tell them, and the others anywhere (``away`` from it: at = seed xor away, mostly 0).  So a seed has at most one such row for each group of records,
    unless one record repeats it, and one that is in any share of all records makes no hot key.
    """

    def table(doc: pa.Array, held: list) -> pa.RecordBatch:
        row, seed, run, start, size = map(np.concatenate, zip(*held))
        order = np.argsort(seed, kind="stable")  # rows ascend, so a group's first and last row differ if any two do
        s, r = seed[order], row[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        last = np.r_[first[1:], len(s)] - 1
        count = last - first + 1
        known = np.repeat(r[first] != r[last], count)
        head = np.zeros(len(s), bool)
        head[first] = True
        away = np.zeros(len(s), np.uint64)
        away[order] = np.where(known & ~head, _mix(np.arange(len(s), dtype=np.uint64) * np.uint64(BASE) + r.astype(np.uint64)), np.uint64(0))
        told = np.zeros(len(s), bool)
        told[order] = known
        columns = [doc.take(pa.array(row)).cast(pa.int64()), pa.array((seed ^ away).view(np.int64)), pa.array(away.view(np.int64)), pa.array(run.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(told)]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "at", "away", "run", "start", "size", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            held, size = [], 0
            for block in blocks(segments((t.as_py() for t in batch.column("text")), span)):
                number, start = np.array([p[0] for p in block]), np.array([p[1] for p in block])
                text, seed, whole, first, last = minimizer_runs(hasher, [p[2] for p in block], span, k)
                held.append((number[text], seed, whole, first + start[text], last - first + span))
                size += len(text)
                if size > GROUP:
                    yield table(batch.column("doc"), held)
                    held, size = [], 0
            if held:
                yield table(batch.column("doc"), held)

    return run


def _windows(span: int):
    """Hash of every window of the stretches asked for: one row per text, with the lists of its stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for i in range(batch.num_rows):
                text, asked = batch.column("text")[i].as_py(), batch.column("asked")[i].values
                seed, run_, start, size, lone = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("seed", "run", "start", "size", "lone"))
                for block in blocks((j, text[a : a + n]) for j, (a, n) in enumerate(zip(start.tolist(), size.tolist()))):
                    which = np.array([j for j, _ in block])
                    offset, window, piece = inside(np.array([len(p) for _, p in block]), span)
                    hasher.read("".join(p for _, p in block))
                    which, step = which[piece], window - offset[piece]
                    columns = [pa.repeat(batch.column("doc")[i], len(which)), pa.array(seed[which]), pa.array(run_[which]), pa.array(step.astype(np.int32)), pa.array((start[which] + step).astype(np.int32)), pa.array(hasher.of(window, window + span).view(np.int64)), pa.array(lone[which])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "seed", "run", "step", "begin", "code", "lone"])

    return run


def chain(x: np.ndarray, y: np.ndarray, size: np.ndarray, gap_cost: float, max_gap: int) -> list[list[int]]:
    """Best collinear chains of matches, each match in one chain; matches are sorted by x.

    A match may follow another that ends before it in both texts, at most ``max_gap`` characters before in each; a gap
    costs ``gap_cost`` for every character of it.  As the cost is linear, the best predecessor is a maximum over ends in
    the window of y, kept in a segment tree with a leaf for each match; matches enter it in the order of their ends in x
    and leave it when these lie more than ``max_gap`` back.
    """
    n = len(x)
    order = np.argsort(y + size, kind="stable")
    leaf = np.empty(n, np.int64)
    leaf[order] = np.arange(n) + n
    ends = (y + size)[order]
    low, high = np.searchsorted(ends, y - max_gap, side="left") + n, np.searchsorted(ends, y, side="right") + n
    nothing = (-np.inf, -1)
    tree: list[tuple[float, int]] = [nothing] * (2 * n)

    def put(at: int, value: tuple[float, int]) -> None:
        tree[at] = value
        while at > 1:
            at >>= 1
            tree[at] = max(tree[2 * at], tree[2 * at + 1])

    score, parent = size.astype(float), np.full(n, -1)
    waiting = np.argsort(x + size, kind="stable")
    done = (x + size)[waiting]
    entered = left = 0
    for i in range(n):
        while entered < n and done[entered] <= x[i]:
            j = int(waiting[entered])
            put(int(leaf[j]), (score[j] + gap_cost * (x[j] + y[j] + 2 * size[j]), j))
            entered += 1
        while left < entered and done[left] < x[i] - max_gap:
            put(int(leaf[waiting[left]]), nothing)
            left += 1
        a, b, best = int(low[i]), int(high[i]), nothing
        while a < b:
            if a & 1:
                best = max(best, tree[a])
                a += 1
            if b & 1:
                b -= 1
                best = max(best, tree[b])
            a >>= 1
            b >>= 1
        gain = best[0] - gap_cost * (x[i] + y[i])
        if gain > 0:
            score[i] += gain
            parent[i] = best[1]
    used, out = np.zeros(n, bool), []
    for i in np.argsort(-score, kind="stable"):
        if not used[i]:
            path = []
            j = int(i)
            while j >= 0 and not used[j]:
                used[j] = True
                path.append(j)
                j = int(parent[j])
            out.append(path[::-1])
    return out


def _join_matches(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches that overlap or touch on one diagonal are one match."""
    if len(x) < 2:
        return x, y, size
    order = np.lexsort((x, y - x))
    x, y, end = x[order], y[order], (x + size)[order]
    diagonal = np.cumsum(np.r_[0, (y - x)[1:] != (y - x)[:-1]]) << 32
    top = np.maximum.accumulate(end + diagonal) - diagonal
    new = np.r_[True, (diagonal[1:] != diagonal[:-1]) | (x[1:] > top[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(x) - 1]
    x, y, size = x[first], y[first], top[last] - x[first]
    order = np.lexsort((y, x))
    return x[order], y[order], size[order]


def _chains(gap_cost: float, max_gap: int):
    """Rows sorted by record and partner; the matches of one pair are held at a time."""

    def pair(doc: int, other: int, rows: list) -> tuple:
        x, y, size = _join_matches(*map(np.concatenate, zip(*rows)))
        number = np.zeros(len(x), np.int32)
        if len(x) > 1:
            for k, path in enumerate(chain(x, y, size, gap_cost, max_gap)):
                number[path] = k
        return np.full(len(x), doc), np.full(len(x), other), number, x, y, size

    def table(done: list) -> pa.RecordBatch:
        doc, other, number, x, y, size = map(np.concatenate, zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(other), pa.array(number), *[pa.array(v.astype(np.int32)) for v in (x, y, size)]], names=["doc", "other", "chain", "x", "y", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, done = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, other, x, y, size = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "other", "x", "y", "size"))
            change = np.flatnonzero((doc[1:] != doc[:-1]) | (other[1:] != other[:-1])) + 1
            edges = [0, *change.tolist(), len(doc)]
            for a, b in zip(edges, edges[1:]):
                if (doc[a], other[a]) != now:
                    if rows:
                        done.append(pair(*now, rows))
                    now, rows = (doc[a], other[a]), []
                rows.append((x[a:b], y[a:b], size[a:b]))
            if sum(len(d[0]) for d in done) > 1 << 15:
                yield table(done)
                done = []
        if rows:
            done.append(pair(*now, rows))
        if done:
            yield table(done)

    return run


def _docs(df: DataFrame, ident: str, text: str, min_span: int) -> DataFrame:
    docs = df.select(F.col(f"`{ident}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    return docs.where(F.col("doc").isNotNull() & (F.char_length("text") >= min_span))


def _shared_runs(docs: DataFrame, span: int, k: int) -> DataFrame:
    """``doc``, ``seed``, ``run``, ``start``, ``size`` of all runs whose seed stands in several records, checkpointed; texts are read and hashed once."""
    if not 16 <= k <= span <= BLOCK // 4:
        raise ValueError(f"seed_length must be from 16 to min_span, and min_span at most {BLOCK // 4}")
    runs = docs.mapInArrow(_seeds(span, k), "doc BIGINT, at BIGINT, away BIGINT, run BIGINT, start INT, size INT, known BOOLEAN")
    same = Window.partitionBy("at")
    told = runs.withColumns({"lo": F.min("doc").over(same), "hi": F.max("doc").over(same), "told": F.max("known").over(same)})
    return checkpointed(told.where("told OR lo < hi").select("doc", F.col("at").bitwiseXOR(F.col("away")).alias("seed"), "run", "start", "size"))


def _ends(of: DataFrame, keys: list[str], place: str, *more) -> DataFrame:
    """Of each class its smallest and largest record, ``a`` and ``b``, with the first place in each."""
    lo, hi = F.min(F.struct("doc", F.col(place).alias("p"))), F.max(F.struct("doc", (-F.col(place)).alias("p")))
    found = of.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"), *more)
    return found.select(*keys, F.col("lo.doc").alias("a"), F.col("lo.p").alias("a_start"), F.col("hi.doc").alias("b"), (-F.col("hi.p")).alias("b_start"), *[c for c in found.columns if c not in (*keys, "lo", "hi")])


def shared_spans(df: DataFrame, ident: str, text: str, min_span: int = 160, seed_length: int = 96, gap_cost: float = 0.5, max_gap: int = 400) -> DataFrame:
    """Exact spans of at least ``min_span`` characters that stand in another record too, in collinear chains.

    Columns ``doc``, ``other``, ``chain``, ``x``, ``y``, ``size``: characters x .. x+size of ``doc`` are characters
    y .. y+size of ``other``.  Matches of a chain follow each other in both texts.  Every character of every span that
    a record shares with any other is in one of its rows; each is shown with one partner that has it, not with all
    (``fuzzy_passages`` looks at all matches of a pair).

    1. Every window of ``min_span`` characters picks a seed of ``seed_length``; neighbouring windows with one seed are
       a run.  Runs of seeds that occur in one record only drop out; texts are read once for that.
    2. Equal runs are one class.  A class that occurs in several records is shared whole, and each member is matched
       with the class's smallest (the smallest itself with the largest) record: no pairs of members are formed.
    3. Of seeds with several classes, all windows of one run per class (two, if several records have it) are compared
       in the same way.  So a seed that is in any share of all records costs as many rows as it has occurrences.
    4. Matches of two records that touch on a diagonal are joined and chained by a segment tree with ``gap_cost`` a
       character; gaps are at most ``max_gap`` long.

    Characters are code points.  ``ident`` is an integer column of unique values; rows with a null identifier or text,
    or a text under ``min_span``, have no spans.  Runs and windows are equal when two hashes of 64 bits are, that of the
    seed and that of all their characters.  Texts are processed whole, in overlapping pieces if they are long.  An empty
    table gives no rows.
    """
    docs = _docs(df, ident, text, min_span)
    return _spans(docs, _shared_runs(docs, min_span, seed_length), min_span, gap_cost, max_gap)


def _spans(docs: DataFrame, held: DataFrame, min_span: int, gap_cost: float, max_gap: int) -> DataFrame:
    classes = _ends(held, ["seed", "run"], "start", F.max("size").alias("size"))
    partner = lambda own, a, b: F.when(F.col(own) == F.col("a"), F.col(b)).otherwise(F.col(a))
    both = classes.where("a < b").drop("size")
    whole = held.join(both, ["seed", "run"]).select("doc", partner("doc", "a", "b").alias("other"), F.col("start").alias("x"), partner("doc", "a_start", "b_start").alias("y"), "size")

    several = classes.groupBy("seed").agg(F.count("*").alias("n"), F.min("a").alias("l"), F.max("b").alias("h")).where("n > 1 AND l < h").select("seed")
    sides = F.array_distinct(F.array(F.struct(F.col("a").alias("doc"), F.col("a_start").alias("start")), F.struct(F.col("b").alias("doc"), F.col("b_start").alias("start"))))
    one_each = classes.join(several, "seed", "left_semi").select("seed", "run", "size", (F.col("a") == F.col("b")).alias("lone"), F.explode(sides).alias("s")).select("seed", "run", "size", "lone", "s.doc", "s.start")
    asked = one_each.groupBy("doc").agg(F.collect_list(F.struct("seed", "run", "start", "size", "lone")).alias("asked"))
    windows = asked.join(docs, "doc").select("doc", "asked", "text").mapInArrow(_windows(min_span), "doc BIGINT, seed BIGINT, run BIGINT, step INT, begin INT, code BIGINT, lone BOOLEAN")
    windows = checkpointed(windows)
    met = _ends(windows, ["seed", "code"], "begin").where("a < b")
    part = windows.where("lone").join(met, ["seed", "code"]).select("seed", "run", "step", partner("doc", "a", "b").alias("other"), partner("doc", "a_start", "b_start").alias("y"))
    part = held.join(part, ["seed", "run"]).select("doc", "other", (F.col("start") + F.col("step")).alias("x"), "y", F.lit(min_span).alias("size"))

    matches = whole.unionByName(part).repartition("doc", "other").sortWithinPartitions("doc", "other", "x", "y")
    return matches.mapInArrow(_chains(gap_cost, max_gap), "doc BIGINT, other BIGINT, chain INT, x INT, y INT, size INT")


def shared_lengths(spans: DataFrame, ident: str) -> DataFrame:
    """``ident`` and ``shared_chars`` INT: characters of each record in the union of its shared spans."""
    one = spans.groupBy("doc", "x").agg(F.max("size").alias("size"))
    ahead = F.max(F.col("x") + F.col("size")).over(Window.partitionBy("doc").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("x") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("x"), F.coalesce("ahead", F.lit(0))))
    return one.withColumn("ahead", ahead).groupBy("doc").agg(F.sum(fresh).cast("int").alias("shared_chars")).withColumnRenamed("doc", ident)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance with a column of the table in two integers (Myers, "A fast bit-vector algorithm for approximate string matching based on dynamic programming", JACM 1999)."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    rise, fall, out = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        zero = (((eq & rise) + rise) ^ rise) | eq | fall
        up, down = fall | (full & ~(zero | rise)), rise & zero
        out += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full
        down = down << 1 & full
        rise, fall = down | (full & ~(zero | up)), up & zero
    return out


def exact_matches(hasher: Hasher, a: str, b: str, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal exact matches of at least ``span`` characters of two texts; of a stretch that ``b`` repeats, the first place."""

    def codes(text: str) -> np.ndarray:
        out = []
        for _, _, piece in segments([text], span):
            hasher.read(piece)
            out.append(hasher.all(span))
        return np.concatenate(out)

    left, right = codes(a), codes(b)
    seen, first = np.unique(right, return_index=True)
    at = np.minimum(np.searchsorted(seen, left), len(seen) - 1)
    x = np.flatnonzero(seen[at] == left)
    y = first[at[x]]
    return _join_matches(x, y, np.full(len(x), span))


def _passages(span: int, gap_cost: float, max_gap: int):
    """Chains of two texts with the edit distance of their gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        names = ["doc", "other", "start", "end", "other_start", "other_end", "exact_chars", "edits"]
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                doc, other, a, b = (batch.column(c)[i].as_py() for c in ("doc", "other", "t", "u"))
                x, y, size = exact_matches(hasher, a, b, span)
                for path in chain(x, y, size, gap_cost, max_gap) if len(x) else []:
                    ends = [(int(x[j]), int(x[j] + size[j]), int(y[j]), int(y[j] + size[j])) for j in path]
                    edits = sum(edit_distance(a[p[1] : q[0]], b[p[3] : q[2]]) for p, q in zip(ends, ends[1:]))
                    rows.append((doc, other, ends[0][0], ends[-1][1], ends[0][2], ends[-1][3], int(size[path].sum()), edits))
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    return run


def fuzzy_passages(df: DataFrame, ident: str, text: str, min_span: int = 160, seed_length: int = 96, gap_cost: float = 0.5, max_gap: int = 400) -> DataFrame:
    """Passages that records share but for some gaps: ``doc``, ``other``, ``start``, ``end``, ``other_start``, ``other_end``, ``exact_chars``, ``edits``, ``identity``.

    A pair of records is looked at when one is the other's partner in ``shared_spans``, or when it is its partner for two
    shared seeds of which one is among the next ``FOLLOWERS`` after the other (at most ``max_gap`` and two spans apart):
    its smallest or largest fellow with both.  So
    records meet that share neighbouring spans, even when each span alone has an older record; of a group of records
    with the same two spans each is paired with one, so pairs grow with occurrences.  All exact matches of a pair
    are found on both texts, chained, and their gaps aligned: ``edits`` is the sum of the gaps' edit distances,
    ``identity`` the share exact_chars / (exact_chars + edits).  Only texts of records in pairs are read again.
    """
    docs = _docs(df, ident, text, min_span)
    held = _shared_runs(docs, min_span, seed_length)
    spans = _spans(docs, held, min_span, gap_cost, max_gap)
    order = Window.partitionBy("doc").orderBy("start")
    ahead = F.array(*[F.struct(F.lead("seed", k).over(order).alias("next"), (F.lead("start", k).over(order) - F.col("start")).alias("far")) for k in range(1, FOLLOWERS + 1)])
    steps = held.withColumn("ahead", ahead).select("doc", "seed", F.explode("ahead").alias("s")).where(F.col("s.far") <= max_gap + 2 * min_span).select("doc", "seed", "s.next").distinct()
    both = steps.groupBy("seed", "next").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
    linked = steps.join(both, ["seed", "next"]).select("doc", F.when(F.col("doc") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
    pairs = checkpointed(spans.select("doc", "other").unionByName(linked).distinct())
    named = pairs.select(F.explode(F.array("doc", "other")).alias("doc")).distinct()
    few = checkpointed(docs.join(named, "doc", "left_semi"))
    texts = pairs.join(few.withColumnRenamed("text", "t"), "doc").join(few.select(F.col("doc").alias("other"), F.col("text").alias("u")), "other")
    out = texts.select("doc", "other", "t", "u").mapInArrow(_passages(min_span, gap_cost, max_gap), "doc BIGINT, other BIGINT, start INT, end INT, other_start INT, other_end INT, exact_chars BIGINT, edits BIGINT")
    return out.withColumn("identity", F.col("exact_chars") / (F.col("exact_chars") + F.col("edits")))
