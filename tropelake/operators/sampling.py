"""Reproducible samples: rows are ordered by a hash of their identifier and a seed, so any engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lot(ident: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(ident).cast("string"), F.lit(f"|{seed}")))


def draw(df: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, or all; a top-k, not a sort of the table."""
    return df.orderBy(lot(ident, seed), ident).limit(n)


def draw_each(df: DataFrame, group: list[str], ident: str, n: int, seed: int = 42, prefer: Column | None = None, full_only: bool = False) -> DataFrame:
    """Up to ``n`` rows of every group, those with a smaller ``prefer`` first.  ``full_only``: only groups of at least ``n`` rows."""
    order = [*([prefer.asc()] if prefer is not None else []), lot(ident, seed), F.col(ident)]
    if full_only:
        df = df.join(df.groupBy(*group).agg(F.count("*").alias("__n")).where(F.col("__n") >= n).select(*group), group, "left_semi")
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def draw_stratified(df: DataFrame, stratum: str, ident: str, n: int, strata: int, seed: int = 42) -> DataFrame:
    """``n`` rows: floor(n / strata) of every stratum as far as there are, the rest from what is left."""
    chosen = draw_each(df, [stratum], ident, n // strata, seed)
    rest = df.join(chosen.select(ident), ident, "left_anti")
    pool = chosen.withColumn("__o", F.lit(0)).unionByName(rest.withColumn("__o", F.lit(1)))
    return pool.orderBy("__o", lot(ident, seed), ident).limit(n).drop("__o")


def draw_quota(df: DataFrame, ident: str, score: str, n: int, threshold: float, done: DataFrame | None = None, share: float = 0.9, seed: int = 42) -> DataFrame:
    """``n`` rows, ``share`` of them with at least ``threshold``: each side is drawn evenly over scores rounded to one place, and rows over the threshold fill what is missing.

    A side of m rows with s different rounded scores gives up to m // s of each.  Rows of ``done`` are not drawn again.
    The order of the result is by lot.
    """
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("__s", F.round(score, 1))
    if done is not None:
        rows = rows.join(done.select(ident), ident, "left_anti")
    high = int(share * n)
    sides = [(rows.where(F.col(score) >= threshold), high), (rows.where(F.col(score) < threshold), n - high)]
    chosen = None
    for part, size in sides:
        counts = part.agg(F.countDistinct("__s").alias("__k"))
        place = F.row_number().over(Window.partitionBy("__s").orderBy(lot(ident, seed), ident))
        got = part.withColumn("__r", place).crossJoin(F.broadcast(counts)).where(F.col("__r") <= F.floor(F.lit(size) / F.col("__k"))).drop("__r", "__k")
        chosen = got if chosen is None else chosen.unionByName(got)
    rest = sides[0][0].join(chosen.select(ident), ident, "left_anti")
    pool = chosen.withColumn("__o", F.lit(0)).unionByName(rest.withColumn("__o", F.lit(1)))
    drawn = pool.orderBy("__o", lot(ident, seed), ident).limit(n)
    return drawn.orderBy(lot(ident, seed + 1), ident).drop("__o", "__s")


def shuffled_documents(df: DataFrame, doc: str, order: list[str], seed: int = 42) -> DataFrame:
    """Documents in a random order, each with its members together and in order."""
    return df.orderBy(lot(doc, seed), doc, *order)


def shuffled_places(df: DataFrame, doc: str, order: list[str], seed: int = 42) -> DataFrame:
    """Rows with their ``place`` 1, 2, … in that order, without one task for all rows; ``doc`` and ``order`` together are unique."""
    from .ranking import running_total

    keyed = df.withColumn("__k", F.struct(lot(doc, seed).alias("__l"), doc, *order)).withColumn("__one", F.lit(1).cast("long"))
    return running_total(keyed, "__k", "__one", "place").withColumn("place", F.col("place") + 1).drop("__k", "__one")


def bucket(ident: str, n: int, seed: int = 42) -> Column:
    """A number below ``n`` for each identifier."""
    return F.pmod(F.conv(F.substring(lot(ident, seed), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def split(df: DataFrame, ident: str, parts: dict[str, int], seed: int = 42) -> DataFrame:
    """A column ``split`` with the name of a part; parts have their percentages."""
    b, low, name = bucket(ident, 100, seed), 0, None
    for part, percent in parts.items():
        low += percent
        name = F.when(b < low, part) if name is None else name.when(b < low, part)
    return df.withColumn("split", name)


def holdout(df: DataFrame, group: str, value: str, ident: str, validation: int = 10, seed: int = 42) -> DataFrame:
    """Leave one group out: its rows are test rows, a share of the others validates."""
    return df.withColumn("split", F.when(F.col(group) == value, "test").when(bucket(ident, 100, seed) < validation, "validation").otherwise("train"))


def random_labels(df: DataFrame, ident: str, labels: list[str], seed: int = 42) -> DataFrame:
    """The baseline that guesses: a label by lot."""
    return df.withColumn("prediction", F.element_at(F.array(*[F.lit(x) for x in labels]), bucket(ident, len(labels), seed) + 1))


def inverse_usage(options: DataFrame, ident: str, draws: int, seed: int = 42) -> DataFrame:
    """``draw_no`` and ``ident``: as often as each option may come once, it comes once, each round in another order.

    The effect of weights 1 / (uses + 1): usage never differs by more than one.  No state passes between draws.
    """
    n = options.count()
    rounds = -(-draws // max(1, n))
    rows = options.select(ident, F.explode(F.sequence(F.lit(0), F.lit(max(0, rounds - 1)))).alias("__t"))
    order = [F.col("__t"), F.md5(F.concat(F.col(ident).cast("string"), F.lit("|"), F.col("__t").cast("string"), F.lit(f"|{seed}"))), F.col(ident)]
    return rows.orderBy(*order).limit(draws).withColumn("draw_no", F.row_number().over(Window.orderBy(*order)) - 1).select("draw_no", ident)
