"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import checkpointed

#: Stretches of the seeded order of a pattern's documents, each sorted by itself.
BUCKETS = 1024
#: Rows of a plan that are sent to every executor.
SMALL = 100_000


class Flow:
    """Tokens from patterns to sources, on edges (pattern, source) with a capacity; ``left`` is what a pattern, ``quota`` what a source still has.

    Paths are looked for between sources, of which there are few: a source passes amounts on to another through all
    patterns that both have, so an augmentation moves tokens of many patterns at once.
    """

    def __init__(self, pattern: np.ndarray, source: np.ndarray, room: np.ndarray, quota: np.ndarray, n_patterns: int):
        self.pattern, self.source, self.room, self.quota = pattern, source, room.copy(), quota.copy()
        self.flow = np.zeros(len(pattern), np.int64)
        self.left = np.zeros(n_patterns, np.int64)
        order = np.argsort(source, kind="stable")
        self.edges = np.split(order, np.searchsorted(source[order], np.arange(1, len(quota))))

    def _sums(self, amount: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.quota), np.int64)
        np.add.at(out, self.source, amount)
        return out

    def _movable(self, to: int) -> np.ndarray:
        """What each edge's source could hand over to source ``to``."""
        space = np.zeros(len(self.left), np.int64)
        space[self.pattern[self.edges[to]]] = self.room[self.edges[to]]
        out = np.minimum(self.flow, space[self.pattern])
        out[self.edges[to]] = 0
        return out

    @staticmethod
    def _take(amount: int, of: np.ndarray) -> np.ndarray:
        """The first ``amount`` of the amounts in ``of``."""
        return np.clip(amount - (np.cumsum(of) - of), 0, of)

    def fill(self) -> None:
        """Augments until nothing more can reach a source with quota left."""
        while self._augment():
            pass

    def _augment(self) -> bool:
        direct = self._sums(np.minimum(self.left[self.pattern], self.room))
        after = np.full(len(self.quota), -1)
        line = np.flatnonzero(self.quota > 0).tolist()
        after[line] = line
        movable, at = {}, 0
        begin = next((s for s in line if direct[s]), -1)
        while begin < 0 and at < len(line):
            to = line[at]
            at += 1
            hand = self._sums(self._movable(to))
            for s in np.flatnonzero((hand > 0) & (after < 0)).tolist():
                after[s], movable[s] = to, int(hand[s])
                line.append(s)
                if direct[s]:
                    begin = s
                    break
        if begin < 0:
            return False
        path = [begin]
        while after[path[-1]] != path[-1]:
            path.append(int(after[path[-1]]))
        amount = min(int(direct[begin]), int(self.quota[path[-1]]), *[movable[s] for s in path[:-1]])
        mine = self.edges[begin]
        got = self._take(amount, np.minimum(self.left[self.pattern[mine]], self.room[mine]))
        moves = [(mine, got)]
        for a, b in zip(path, path[1:]):
            out = self._take(amount, self._movable(b)[self.edges[a]])
            moves.append((self.edges[a], -out))
            place = np.zeros(len(self.left), np.int64)
            place[self.pattern[self.edges[a]]] = out
            moves.append((self.edges[b], place[self.pattern[self.edges[b]]]))
        self.left[self.pattern[mine]] -= got
        for edge, change in moves:
            self.flow[edge] += change
            self.room[edge] -= change
        self.quota[path[-1]] -= amount
        return True


def plan(patterns: dict[tuple[str, ...], int], targets: list[tuple[str, float, int]], total: int) -> list[tuple[tuple[str, ...], str, int]]:
    """Tokens that each membership pattern gives to each of its sources: (pattern, source, hundredths of a token).

    The cheapest of the largest flows from patterns to sources.  A source takes its weight's share of ``total``, and of
    a pattern at most its tokens times the source's passes.  The tokens of a pattern cost one more with every
    repetition, whichever sources it serves, so costs are convex and sources that share documents compete for them.
    As only the edges into patterns have costs, and equal ones for equal repetitions, the flow is cheapest when
    repetitions are allowed one by one and the flow is made largest each time: an augmentation never takes back what
    a pattern has given.  Amounts are hundredths of tokens, so percent weights stay whole.
    """
    names = {s: i for i, (s, _, _) in enumerate(targets)}
    passes = np.array([p for _, _, p in targets], np.int64)
    keys = sorted(patterns)
    tokens = np.array([100 * patterns[p] for p in keys], np.int64)
    edges = [(k, names[s]) for k, p in enumerate(keys) for s in p if s in names]
    pattern, source = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
    flow = Flow(pattern, source, tokens[pattern] * passes[source], np.array([round(w * total) for _, w, _ in targets], np.int64), len(keys))
    most = np.zeros(len(keys), np.int64)
    np.add.at(most, pattern, passes[source])
    for turn in range(1, int(most.max(initial=0)) + 1):
        if not (flow.quota > 0).any():
            break
        flow.left += np.where(most >= turn, tokens, 0)
        flow.fill()
    return [(keys[k], targets[s][0], int(f)) for k, s, f in zip(pattern, source, flow.flow) if f]


class Mixture:
    """Documents of several sources, mixed so that each source gives its weight's share of all tokens.

    ``documents``: ``ident``, ``n_tokens`` and ``sources`` (ARRAY<STRING>, labels without outer blanks and case).
    ``targets``: list of (source, weight in percent, most passes); bounded by nature and checked to be at most 10 000.  A
    null source is left out, a null weight or number of passes is 0.

    Token sums are aggregated by membership pattern first, of which at most ``max_patterns`` may occur (else an error); the
    flow is solved on those sums, so the driver holds no documents.  Documents with a null identifier, no tokens or none
    of the sources take no part.  Repeated rows are documents of their own.  A source without documents gets nothing.
    """

    def __init__(self, documents: DataFrame, ident: str, targets: list[tuple[str, float, int]], seed: int = 42, max_patterns: int = 500_000):
        targets = [(s, w or 0, max(0, p or 0)) for s, w, p in targets if s is not None]
        if len(targets) > 10_000 or len({s for s, _, _ in targets}) < len(targets):
            raise ValueError("targets must be at most 10 000 different sources")
        self.targets, self.seed, self.ident = targets, seed, ident
        spark = documents.sparkSession
        wanted = F.array(*[F.lit(s) for s, _, _ in targets]) if targets else F.array().cast("array<string>")
        self.rows = documents.where(F.col(f"`{ident}`").isNotNull() & (F.col("n_tokens") > 0)).select(F.col(f"`{ident}`").alias("id"), "n_tokens", F.array_sort(F.array_intersect("sources", wanted)).alias("pattern")).where(F.size("pattern") > 0)
        self.rows = checkpointed(self.rows)
        found = self.rows.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).take(max_patterns + 1)
        if len(found) > max_patterns:
            raise ValueError(f"more than {max_patterns} membership patterns")
        patterns = {tuple(r.pattern): r.n for r in found}
        self.total = sum(patterns.values())
        self.given = plan(patterns, self.targets, self.total)
        self.spark, self.patterns = spark, patterns

    def shares(self) -> list[tuple[str, int, int, int]]:
        """Of each target in order: source, passes begun, whether its share is reached, tokens that the flow gives it."""
        begun, got = {}, {}
        for p, s, f in self.given:
            begun[s] = max(begun.get(s, 0), -(-f // (100 * self.patterns[p])))
            got[s] = got.get(s, 0) + f
        return [(s, begun.get(s, 0), int(got.get(s, 0) >= round(weight * self.total)), got.get(s, 0) // 100) for s, weight, _ in self.targets]

    def parts(self) -> DataFrame:
        """``pattern``, ``source``, ``whole`` passes, and the begun pass as stretches ``low`` <= place < ``high`` of the pattern's tokens in seeded order.

        The begun passes of a pattern's sources follow each other round that order, so its documents are repeated evenly.
        """
        rows, turn = [], {}
        for p, s, f in self.given:
            whole, rest = divmod(f, 100 * self.patterns[p])
            rest, size, low = -(-rest // 100), self.patterns[p], turn.get(p, 0)
            turn[p] = (low + rest) % size
            rows.append((list(p), s, int(whole), low, low + rest, max(0, low + rest - size)))
        return self.spark.createDataFrame(rows, "pattern ARRAY<STRING>, source STRING, whole INT, low LONG, high LONG, round LONG")

    def selection(self) -> DataFrame:
        """``source``, ``ident``, ``n_tokens``, ``n_copies``: documents of the mixture.

        Whole passes take every document of the pattern; the begun last pass takes documents in the order of a seeded
        hash until the rest is reached.  A document's place in that order is the sum of tokens before it: of earlier hash
        buckets, from one aggregation, and inside its own, so no pattern is sorted in one task.
        """
        lot = F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|{self.seed}")))
        rows = self.rows.withColumn("lot", lot).withColumn("bucket", F.shiftright(F.conv(F.substring("lot", 1, 3), 16, 10).cast("int"), 2))
        sums = rows.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n"))
        sums = sums.select("pattern", "bucket", (F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n")).alias("earlier"))
        sofar = F.sum("n_tokens").over(Window.partitionBy("pattern", "bucket").orderBy("lot", "id").rowsBetween(Window.unboundedPreceding, -1))
        placed = rows.withColumn("sofar", F.coalesce(sofar, F.lit(0))).join(sums, ["pattern", "bucket"]).withColumn("place", F.col("earlier") + F.col("sofar"))
        parts = self.parts()
        joined = placed.join(F.broadcast(parts) if len(self.given) <= SMALL else parts, "pattern")
        place = F.col("place")
        more = ((place >= F.col("low")) & (place < F.col("high"))) | (place < F.col("round"))
        return joined.withColumn("n_copies", F.col("whole") + more.cast("int")).where("n_copies > 0").select("source", F.col("id").alias(self.ident), "n_tokens", "n_copies")
