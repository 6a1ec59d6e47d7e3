"""Top N items within every group, by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_n(n: int):
    """Of rows that arrive sorted by group and rank, pass the first ``n`` of each group; only the last group's key and count are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("grp")
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            carried = last is not None and key[0].as_py() == last
            new[0] = not carried
            starts = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            rank = np.arange(batch.num_rows)
            if carried:
                head = rank + seen
                rank = np.where(of < 0, head, rank - starts[np.maximum(of, 0)]) if len(starts) else head
            else:
                rank = rank - starts[of]
            last, seen = key[batch.num_rows - 1].as_py(), int(rank[-1]) + 1
            keep = rank < n
            if keep.any():
                out = batch.filter(pa.array(keep))
                ranks = pa.array((rank[keep] + 1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ranks if name == "rank" else out.column(name) for name in out.schema.names], names=out.schema.names)

    return run


def top_n_per_group(df: DataFrame, group: str, score: str, ident: str, n: int, descending: bool = False) -> DataFrame:
    """The ``n`` rows of every group with the smallest (``descending``: largest) score; equal scores go by the smaller identifier.

    Secondary sort: every partition is sorted by group, score and identifier and sends on at most ``n`` rows per
    group, then the rows are hash-partitioned by group, sorted again and cut to ``n``.  Rows stream through in
    Arrow batches; no group is ever held, and a group with any share of all rows costs its last task at most ``n``
    rows per partition before it.

    Returns columns ``group``, ``ident``, ``score`` under their own names and ``rank`` INT from 1.  Only these three
    columns of ``df`` are read.  Rows in which one of them is null, or the score NaN, have no place and drop out.
    Repeated rows are separate rows.  A group of fewer rows comes out whole; an empty table gives an empty result.
    """
    kind = dict(df.dtypes)[score]
    value = F.col(f"`{score}`")
    usable = value.isNotNull() & F.col(f"`{group}`").isNotNull() & F.col(f"`{ident}`").isNotNull()
    if kind in ("float", "double"):
        usable &= ~F.isnan(value)
        value = value + F.lit(0.0).cast(kind)  # one zero, not two
    rows = df.where(usable).select(F.col(f"`{group}`").alias("grp"), value.alias("score"), F.col(f"`{ident}`").alias("ident"), F.lit(0).alias("rank"))
    order = ["grp", F.desc("score") if descending else F.asc("score"), "ident"]
    for k in (0, 1):
        if k:
            rows = rows.repartition("grp")
        rows = rows.sortWithinPartitions(*order).mapInArrow(_first_n(n), rows.schema)
    return rows.select(F.col("grp").alias(group), F.col("ident").alias(ident), F.col("score").alias(score), "rank")


def latest(df: DataFrame, ident: str, stamp: str, columns: list[str]) -> DataFrame:
    """One row for each identifier: that with the latest ``stamp`` (a null stamp is the earliest; equal ones go by the columns' values).

    Rows with a null identifier belong to no record and drop out.
    """
    best = F.max(F.struct(F.col(f"`{stamp}`").alias("stamp"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]))
    rows = df.where(F.col(f"`{ident}`").isNotNull()).groupBy(F.col(f"`{ident}`").alias("ident")).agg(best.alias("best"))
    return rows.select(F.col("ident").alias(ident), *[F.col(f"best.c{i}").alias(c) for i, c in enumerate(columns)])
