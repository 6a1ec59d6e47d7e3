"""Cannot-link constraints without a pair table.

Two rows may not be together when their feature combinations differ, so the constraints form a complete multipartite
graph over the combinations: every count has a closed form in group sizes.  Rows with a null feature have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import percentiles
from .sampling import draw


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def cannot_link_count(df: DataFrame, features: list[str]) -> DataFrame:
    groups = df.dropna(subset=features).groupBy(*features).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return groups.agg((_pairs(total) - F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0))).cast("long").alias("n_constraints"))


def violations_by_cluster(df: DataFrame, label: str, features: list[str], eligible: Column | None = None) -> DataFrame:
    """Pairs in one cluster whose features differ, of ``eligible`` rows."""
    rows = df.dropna(subset=features)
    if eligible is not None:
        rows = rows.where(eligible)
    cells = rows.groupBy(label, *features).agg(F.count("*").alias("n"))
    return cells.groupBy(label).agg((_pairs(F.sum("n")) - F.sum(_pairs(F.col("n")))).cast("long").alias("violations"))


def violation_count(df: DataFrame, label: str, features: list[str], eligible: Column | None = None) -> DataFrame:
    return violations_by_cluster(df, label, features, eligible).agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"))


def persistent_pairs(history: DataFrame, i: str = "i", j: str = "j", turn: str = "iteration") -> DataFrame:
    """Pairs that occur in every iteration of a history of violations."""
    turns = history.agg(F.countDistinct(turn).alias("__t"))
    return history.groupBy(i, j).agg(F.countDistinct(turn).alias("__n")).crossJoin(F.broadcast(turns)).where("__n = __t").select(i, j)


def violation_frequency(history: DataFrame, i: str = "i", j: str = "j", turn: str = "iteration") -> DataFrame:
    """``i``, ``j``, ``n_iterations`` and ``frequency``: in how many iterations of a history, and in what share of them, each pair occurs."""
    turns = history.agg(F.countDistinct(turn).alias("__t"))
    counts = history.groupBy(i, j).agg(F.countDistinct(turn).alias("n_iterations"))
    return counts.crossJoin(F.broadcast(turns)).select(i, j, "n_iterations", (F.col("n_iterations") / F.col("__t")).alias("frequency"))


def most_violated(history: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` pairs that occur in most iterations; of equal ones the smaller come first."""
    return violation_frequency(history).orderBy(F.desc("n_iterations"), "i", "j").limit(n)


def violation_trend(counts: DataFrame, turn: str = "iteration", count: str = "violations") -> DataFrame:
    """One row, ``trend``: decreasing or increasing from the first to the last iteration, "consistently" if no step goes the other way (decides from three iterations on)."""
    step = F.col(count) - F.lag(count).over(Window.orderBy(turn))  # a row for each iteration
    steps = counts.withColumn("__s", step).agg(F.count("*").alias("n"), F.coalesce(F.max("__s"), F.lit(0)).alias("up"), F.coalesce(F.min("__s"), F.lit(0)).alias("down"), (F.max_by(count, turn) - F.min_by(count, turn)).alias("all"))
    plain = F.when(F.col("all") < 0, "decreasing").otherwise("increasing")
    return steps.where("n > 0").select(F.when((F.col("n") > 2) & (F.col("down") >= 0), "consistently increasing").when((F.col("n") > 2) & (F.col("up") <= 0), "consistently decreasing").otherwise(plain).alias("trend"))


def thresholds(df: DataFrame, distance: str, percent: float) -> DataFrame:
    """The percentile of the distances to the own centres, with linear interpolation."""
    return percentiles(df, [], distance, {"threshold": percent / 100})


def pairwise_threshold(df: DataFrame, ident: str, vector: str, percent: float, sample: int = 1000, seed: int = 42) -> float | None:
    """The percentile of the distances between all rows of a hash sample of ``sample`` rows; null for fewer than two."""
    import numpy as np

    rows = draw(df.where(F.col(vector).isNotNull()).select(ident, F.col(vector).alias("v")), ident, sample, seed).collect()
    x = np.array([r["v"] for r in rows], float)
    if len(x) < 2:
        return None
    far = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * x @ x.T, 0))
    return float(np.percentile(far[np.triu_indices(len(x), 1)], percent))


def eligible_rows(df: DataFrame, distance: str, percent: float | None) -> DataFrame:
    """A column ``eligible``: at most the percentile away from the own centre; without a percentile all are."""
    if percent is None:
        return df.withColumn("eligible", F.lit(True))
    return df.crossJoin(F.broadcast(thresholds(df, distance, percent))).withColumn("eligible", F.col(distance) <= F.col("threshold")).drop("threshold")
