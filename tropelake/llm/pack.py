"""Filling fixed-capacity containers: vector best-fit under several capacities.

Panigrahy, Talwar, Uyeda and Wieder, "Heuristics for vector bin packing", 2011: an item goes to the bin that has room in
every dimension and whose residual fits it best, by weighted dot-product or by the norm of what stays free.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import checkpointed


class Bins:
    """Open bins of one shard, by classes of equal residual capacities; a bin that is full in any dimension is closed."""

    def __init__(self, capacity: np.ndarray, rule: str, weights: np.ndarray):
        self.capacity, self.rule, self.weights = capacity, rule, weights
        self.left = np.zeros((64, len(capacity)), np.int64)
        self.names: list[list[int]] = []
        self.where: dict[tuple, int] = {}
        self.made = 0

    def put(self, item: np.ndarray, count: int) -> np.ndarray:
        """Bins of ``count`` equal items, one after the other."""
        out = []
        while count:
            k = self._best(item)
            each = min(self._run(self.left[k], item) if k >= 0 else self._fit(self.capacity, item), count)
            bins = count // each if k < 0 else min(count // each, len(self.names[k]))
            if k < 0:
                taken, left = list(range(self.made, self.made + bins)), self.capacity
                self.made += bins
            else:
                taken, left = self.names[k][-bins:], self.left[k].copy()
                del self.names[k][-bins:]
                if not self.names[k]:
                    self._drop(k)
            self._keep(left - each * item, taken)
            out.append(np.repeat(taken, each))
            count -= each * bins
        return np.concatenate(out)

    @staticmethod
    def _fit(left: np.ndarray, item: np.ndarray) -> int:
        return int((left // item).min())

    def _run(self, left: np.ndarray, item: np.ndarray) -> int:
        """Items that the best bin gets before another bin is as good.  With the norm, the bin just used stays the best as long as it has room."""
        fit = self._fit(left, item)
        if self.rule == "norm" or fit == 1:
            return fit
        score = self._score(left - np.arange(fit)[:, None] * item, item)
        worse = np.flatnonzero(score[1:] >= score[0])
        return int(worse[0]) + 1 if len(worse) else fit

    def _score(self, left: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Least where the item fits best."""
        if self.rule == "norm":
            return (((left - item) / self.capacity) ** 2) @ self.weights
        r = left / self.capacity  # the residual that points most along the item, for its length
        return -((r * (item / self.capacity)) @ self.weights) / ((r * r) @ self.weights)

    def _best(self, item: np.ndarray) -> int:
        """The class that fits best, -1 where none has room."""
        left = self.left[: len(self.names)]
        room = np.flatnonzero((left >= item).all(axis=1))
        if not len(room):
            return -1
        return int(room[self._score(left[room], item).argmin()])

    def _keep(self, left: np.ndarray, names: list[int]) -> None:
        if (left <= 0).any():
            return
        key = tuple(left.tolist())
        if key not in self.where:
            n = len(self.names)
            if n == len(self.left):
                self.left = np.vstack([self.left, np.zeros_like(self.left)])
            self.left[n], self.where[key] = left, n
            self.names.append([])
        self.names[self.where[key]] += names

    def _drop(self, k: int) -> None:
        last = len(self.names) - 1
        del self.where[tuple(self.left[k].tolist())]
        if k < last:
            self.left[k], self.names[k] = self.left[last], self.names[last]
            self.where[tuple(self.left[k].tolist())] = k
        self.names.pop()


def pack(counts: DataFrame, ident: str, size: str, capacity: int = 512, max_items: int = 64, attention: float = 1.0, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0), shard_items: int = 65_536) -> DataFrame:
    """Every token of every item in a bin: ``ident``, ``piece_no``, ``start_token``, ``n_tokens``, ``bin`` STRING.

    A bin holds at most ``capacity`` tokens, ``max_items`` pieces and ``attention`` * capacity² of attention cost, the sum
    of its pieces' squared lengths.  An item that is over one of these by itself is cut into the fewest pieces, largest
    ones and one rest; others stay whole.  All three count for the best fit, also where one can't be exceeded: at an
    ``attention`` of 1 or more the cost keeps its limit if the tokens do, but bins of the same tokens differ in it.

    Pieces of ``capacity`` are bins by themselves.  The others are spread by a hash over shards of about ``shard_items``,
    in each of which they go, longest first, to the bin of best fit: ``rule`` is "norm" (least ``weights``-weighted
    squared norm of the free rest) or "dot" (largest weighted dot-product with the residual, over the residual's squared
    norm).  Bins of equal residuals are one class and
    pieces of one length are placed together, so the work grows with lengths and classes, not with pieces.  A shard
    leaves its last bins partly empty, a share that falls as shards grow.

    Only identifiers and sizes are shuffled.  Items of size null, zero or less, and a null identifier, need no room
    and drop out; repeated rows are items of their own.  An empty table gives no rows.
    """
    if min(capacity, max_items) < 1 or attention * capacity**2 < 1 or min(weights) < 0:
        raise ValueError("capacities must hold a piece of one token, and weights must not be negative")
    kind = counts.schema[ident].dataType.simpleString()
    items = counts.where((F.col(f"`{size}`") > 0) & F.col(f"`{ident}`").isNotNull()).select(F.col(f"`{ident}`").alias("id"), F.col(f"`{size}`").cast("int").alias("n"))
    items = checkpointed(items)
    cost = math.floor(attention * capacity**2)
    most = min(capacity, math.isqrt(cost))
    limits, factors = np.array([capacity, max_items, cost], np.int64), np.array(weights, float)
    starts = F.sequence(F.lit(0), F.col("n") - 1, F.lit(most))
    pieces = items.select("id", "n", F.posexplode(starts).alias("k", "start_token")).select("id", (F.col("k") + 1).alias("piece_no"), "start_token", F.least(F.lit(most), F.col("n") - F.col("start_token")).alias("n_tokens"))
    total = pieces.where(F.col("n_tokens") < capacity).count()
    shards = max(1, math.ceil(total / shard_items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, n = batch.column("shard").to_numpy(), batch.column("n_tokens").to_numpy().astype(np.int64)
            edges = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (n[1:] != n[:-1])) + 1).tolist(), len(s)]
            names = np.zeros(len(s), np.int64)
            for a, b in zip(edges, edges[1:]):
                if s[a] != shard:
                    shard, bins = s[a], Bins(limits, rule, factors)
                names[a:b] = bins.put(np.array([n[a], 1, n[a] * n[a]]), b - a)
            named = pc.binary_join_element_wise(batch.column("shard").cast(pa.string()), pa.array(names).cast(pa.string()), "-")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "piece_no", "start_token", "n_tokens")], named], names=["id", "piece_no", "start_token", "n_tokens", "bin"])

    shard = F.pmod(F.xxhash64("id", "piece_no"), F.lit(shards)).cast("int")
    loose = pieces.where(F.col("n_tokens") < capacity).withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions("shard", F.desc("n_tokens"), "id", "piece_no")
    loose = loose.mapInArrow(run, f"id {kind}, piece_no INT, start_token INT, n_tokens INT, bin STRING")
    full = pieces.where(F.col("n_tokens") == capacity).withColumn("bin", F.concat(F.lit("full-"), F.col("id").cast("string"), F.lit("-"), F.col("piece_no").cast("string")))
    return loose.unionByName(full).withColumnRenamed("id", ident)


def pack_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: bins, pieces, tokens, the largest load and the share of room used in percent."""
    bins = packed.groupBy("bin").agg(F.sum("n_tokens").alias("load"), F.count("*").alias("pieces"))
    return bins.agg(F.count("*").alias("n_bins"), F.sum("pieces").alias("n_pieces"), F.sum("load").alias("n_tokens"), F.max("load").alias("max_load"), F.round(100 * F.sum("load") / (F.count("*") * capacity), 3).alias("used_pct"))
