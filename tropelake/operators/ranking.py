"""Ranking inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def top_share(df: DataFrame, group: str, order: list, percent: float, rounding: str = "floor", at_least_one: bool = True) -> DataFrame:
    """The first ``percent`` of every group.  ``rounding`` of the number of rows is floor or ceil; without ``at_least_one`` a small group may have none."""
    size = F.count("*").over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    keep = {"floor": F.floor, "ceil": F.ceil}[rounding](F.col("__size") * percent / 100)
    if at_least_one:
        keep = F.greatest(F.lit(1), keep)
    return df.withColumn("__size", size).withColumn("__rank", rank).where(F.col("__rank") <= keep).drop("__size", "__rank")


def first_n(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """At most ``n`` rows of every group, cut on both sides of the shuffle (WindowGroupLimit)."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def running_number(df: DataFrame, group: list[str], order: list, name: str, start: int = 0) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1 + start)


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The sum of ``value`` over all rows before each, in order of a column without ties.

    Range partitions are summed by themselves and get the totals of those before them, so no task sees all rows.  They are
    checkpointed with their numbers, so a lost executor can't change them.
    """
    rows = checkpointed(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    totals = rows.groupBy("__p").agg(F.sum(value).alias("__t"))
    before = totals.withColumn("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__i", inside).join(before, "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")


def percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of every group with linear interpolation, a column for each name of ``shares``; nulls don't count.

    Equal values are counted first, then ranked over range partitions, so a group may have any number of rows and values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n")).withColumn("__k", F.struct(*group, value))
    ranked = running_total(counts, "__k", "__n", "__r")
    sizes = ranked.groupBy(*[F.col(g).alias(f"__g_{g}") for g in group]).agg(F.sum("__n").alias("__all"), F.min("__r").alias("__first"))
    same = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group] or F.lit(True)
    joined = ranked.join(sizes, same).withColumns({"__v": F.col(value).cast("double"), "__r": F.col("__r") - F.col("__first")})
    cells = []
    for name, share in shares.items():
        at = (F.col("__all") - 1) * F.lit(share)
        for side, place in ((f"__{name}0", F.floor(at)), (f"__{name}1", F.ceil(at))):
            cells.append(F.max(F.when((F.col("__r") <= place) & (place < F.col("__r") + F.col("__n")), F.col("__v"))).alias(side))
        cells.append(F.max(at - F.floor(at)).alias(f"__{name}2"))
    found = joined.groupBy(*group).agg(*cells)
    return found.select(*group, *[(F.col(f"__{n}0") + (F.col(f"__{n}1") - F.col(f"__{n}0")) * F.col(f"__{n}2")).alias(n) for n in shares])
