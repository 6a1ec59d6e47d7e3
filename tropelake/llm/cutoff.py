"""A score cutoff per source that keeps a target fraction.

An order statistic is the minimum of a convex piecewise linear (pinball) loss.  Kelley's cutting planes find it from
losses and subgradients, which are plain sums over the rows (Beliakov, "Parallel calculation of the median and order
statistics on GPUs with application to robust regression", 2011).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import checkpointed

SALT_ROWS = 65_536


def cutoffs(df: DataFrame, source: str, score: str, percent: str, max_rounds: int = 200) -> DataFrame:
    """For each source the highest score that occurs in it and keeps at least ``percent`` percent of its rows: ``source``, ``cutoff``, ``n_rows``, ``n_kept``, ``n_rounds``.

    With n rows the k = ceil(percent * n / 100) best ones are to be kept, at least one, so the cutoff is the j-th
    smallest score, j = n - k + 1, where L(y) = sum of (2j-1) (x-y)+ + (2n-2j+1) (y-x)+ has its only minimum.  Each
    round evaluates every open source's L and subgradient at the meeting point of the tangents at the ends of its
    bracket, as one aggregation over the rows, counted by equal scores before the first.  A bracket closes when its
    point is the cutoff, or when one score is left strictly inside: the snap to the exact neighbouring score.  Ends are
    decided by counts, never by rounded sums.  Every third round takes the middle of the bracket: between scores of
    different sign 0, of very different size the geometric, else the arithmetic one.  That takes at most some 12 and then
    55 such rounds, so ``max_rounds`` is never reached.

    Rows outside a source's bracket stand in its totals.  They are left out of the following sums, and every third
    round, with those of closed sources, out of the rows that are read.  Rows of a large source are spread over salts,
    and no source is ever held by one task.

    Rows with a null source, percent or score, or a score that is NaN or infinite, drop out.  ``percent`` must be
    the same in all rows of a source (the largest counts) and lie between 0 and 100.  All rows of a source may
    have one score; it is then the cutoff.  An empty table gives no rows.
    """
    value = F.col(f"`{score}`").cast("double") + F.lit(0.0)
    usable = F.col(f"`{source}`").isNotNull() & F.col(f"`{percent}`").isNotNull() & value.isNotNull() & (F.abs(value) < float("inf"))
    raw = df.where(usable).select(F.col(f"`{source}`").alias("src"), value.alias("x"), F.col(f"`{percent}`").cast("double").alias("pct"))
    counts = checkpointed(raw.groupBy("src", "x").agg(F.count("*").alias("c"), F.max("pct").alias("pct")))
    total = F.sum(F.col("x") * F.col("c"))
    start = counts.groupBy("src").agg(F.sum("c").alias("n"), F.max("pct").alias("pct"), F.min("x").alias("lo"), F.max("x").alias("hi"), total.alias("total"), F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    n, j, lo, hi = (F.col(c) for c in ("n", "j", "lo", "hi"))
    kept = F.greatest(F.lit(1), F.least(n, F.ceil(F.col("pct") * n / 100 - 1e-9)))
    above, below = (2 * j - 1).cast("double"), (2 * n - 2 * j + 1).cast("double")
    reach = F.greatest(F.lit(1.0), F.abs(lo), F.abs(hi))
    # outside of all scores the loss is a straight line: the bracket opens there
    a, b = lo - reach, hi + reach
    start = start.withColumn("j", n - kept + 1).select(
        "src", "n", "j", "salts", F.lit(0).alias("n_rounds"),
        a.alias("a"), (above * (F.col("total") - n * a)).alias("fa"), (-above * n).alias("ga"), lo.alias("na"), F.lit(0).cast("long").alias("at_most"), F.lit(0.0).alias("sum_low"),
        b.alias("b"), (below * (n * b - F.col("total"))).alias("fb"), (below * n).alias("gb"), hi.alias("nb"), F.lit(0.0).alias("sum_high"),
        F.when(lo == hi, lo).alias("cutoff"), F.when(lo == hi, n).alias("n_kept"),
    )
    state = checkpointed(start)
    salted = counts.join(state.where("cutoff IS NULL").select("src", "salts"), "src").select("src", F.pmod(F.xxhash64("x"), "salts").cast("int").alias("salt"), "x", "c")
    salted = salted.repartition("src", "salt").persist()
    done = []
    try:
        for turn in range(max_rounds):
            done.append(state.where("cutoff IS NOT NULL"))
            state = state.where("cutoff IS NULL")
            if state.isEmpty():
                break
            if turn and turn % 3 == 0:
                inside = salted.join(_asked(state, "na", "nb"), ["src", "salt"]).where(F.col("x").between(F.col("na"), F.col("nb"))).select("src", "salt", "x", "c").persist()
                inside.count()
                salted.unpersist()
                salted = inside
            state = checkpointed(_round(state, salted, middle=turn % 3 == 2))
        else:
            raise RuntimeError(f"cutoffs still open after {max_rounds} rounds")
    finally:
        salted.unpersist()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("src").alias(source), "cutoff", F.col("n").alias("n_rows"), "n_kept", "n_rounds")


def _asked(state: DataFrame, *columns: str) -> DataFrame:
    """Columns of every source for each of its salts."""
    return state.select("src", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *columns)


def _middle(a: Column, b: Column) -> Column:
    low, high = F.greatest(a, F.lit(5e-324)), F.least(b, F.lit(-5e-324))
    apart = F.when((a >= 0) & (b / 4 > low), F.sqrt(low) * F.sqrt(b)).when((b <= 0) & (a / 4 < high), -F.sqrt(-high) * F.sqrt(-a))
    return F.greatest(a, F.least(b, F.when((a < 0) & (b > 0), 0.0).otherwise(F.coalesce(apart, a / 2 + b / 2))))


def _round(state: DataFrame, salted: DataFrame, middle: bool) -> DataFrame:
    """Every open source's loss and subgradient at its next point, and its bracket after that."""
    ga, gb, na, nb = (F.col(c) for c in ("ga", "gb", "na", "nb"))
    meet = (F.col("fb") - F.col("fa") + F.col("a") * ga - F.col("b") * gb) / (ga - gb)
    state = state.withColumn("y", _middle(na, nb) if middle else F.greatest(na, F.least(nb, meet)))
    x, y, c = F.col("x"), F.col("y"), F.col("c")
    zero = F.lit(0).cast("long")
    rows = salted.join(_asked(state, "y", "na", "nb"), ["src", "salt"]).where(x.between(na, nb))
    sums = rows.groupBy("src").agg(
        F.sum(F.when(x < y, c).otherwise(zero)).alias("in_less"), F.sum(F.when(x == y, c).otherwise(zero)).alias("same"),
        F.sum(F.when(x < y, c * x).otherwise(0.0)).alias("in_low"), F.sum(F.when(x > y, c * x).otherwise(0.0)).alias("in_high"),
        F.max(F.when(x < y, x)).alias("before"), F.min(F.when(x > y, x)).alias("after"),
    )
    both = state.join(sums, "src").withColumns({"less": F.col("at_most") + F.col("in_less"), "low": F.col("sum_low") + F.col("in_low"), "high": F.col("sum_high") + F.col("in_high")})
    n, j, less, same, low, high = (F.col(k) for k in ("n", "j", "less", "same", "low", "high"))
    above, below, more = (2 * j - 1).cast("double"), (2 * n - 2 * j + 1).cast("double"), n - less - same
    loss = above * (high - more * y) + below * (less * y - low)
    up, down = less + same < j, less >= j
    pick = lambda test, new, old: F.when(test, new).otherwise(F.col(old)).alias(old)
    moved = both.select(
        "src", "n", "j", "salts", (F.col("n_rounds") + 1).alias("n_rounds"),
        pick(up, y, "a"), pick(up, loss, "fa"), pick(up, below * (less + same) - above * more, "ga"), pick(up, F.col("after"), "na"), pick(up, less + same, "at_most"), pick(up, low + same * y, "sum_low"),
        pick(down, y, "b"), pick(down, loss, "fb"), pick(down, below * less - above * (n - less), "gb"), pick(down, F.col("before"), "nb"), pick(down, high + same * y, "sum_high"),
        F.when(~up & ~down, y).alias("cutoff"), F.when(~up & ~down, n - less).alias("n_kept"),
    )
    snap = F.col("cutoff").isNull() & (na == nb)
    return moved.withColumn("n_kept", F.when(snap, n - F.col("at_most")).otherwise(F.col("n_kept"))).withColumn("cutoff", F.when(snap, na).otherwise(F.col("cutoff")))
