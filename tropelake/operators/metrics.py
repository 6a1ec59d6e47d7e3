"""Evaluation metrics: agreement, classification reports, thresholds, cluster quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import mean_vector, squared_distance, wide
from .ranking import running_total


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def binary_report(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row: tn, fp, fn, tp, precision, recall, f1 of two boolean columns; rows with a null in either drop out."""
    t, p = F.col(truth), F.col(prediction)
    counts = df.dropna(subset=[truth, prediction]).agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))
    return counts.select("*", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_report(df: DataFrame, score: str, label: str, thresholds: list[float], percent: bool = True, predicted: bool = False) -> DataFrame:
    """The report at each threshold of ``score``, of which ``label`` is compared with score >= threshold; ``predicted``: the score predicts and the label is the truth.

    All thresholds are counted in one pass without copying rows.  ``percent``: measures times 100, to two places.
    """
    fp_, fn_ = ("fn", "fp") if predicted else ("fp", "fn")
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    s, y = F.col(score), F.col(label)
    cells = []
    for k, t in enumerate(thresholds):
        cells += [F.count_if((s < t) & ~y).alias(f"tn{k}"), F.count_if((s < t) & y).alias(f"{fp_}{k}"), F.count_if((s >= t) & ~y).alias(f"{fn_}{k}"), F.count_if((s >= t) & y).alias(f"tp{k}")]
    one = rows.agg(*cells)
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{c}{k}").alias(c) for c in ("tn", "fp", "fn", "tp")]) for k, t in enumerate(thresholds)])
    out = one.select(F.explode(each).alias("r")).select("r.*")
    measures = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    if percent:
        measures = [F.bround(100 * m, 2).alias(n) for m, n in zip(measures, ("precision", "recall", "f1"))]
    return out.select("*", *measures)


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums; null when one class is missing.  Ranks come from counts of equal scores."""
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    ranked = running_total(counts, score, "neg", "below")
    wins = ranked.withColumn("w", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return wins.agg(F.try_divide(F.sum("w"), F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_auc_thresholds(df: DataFrame, score: str, human: str, thresholds: list[float]) -> DataFrame:
    """``threshold`` and ``auc`` of ``score`` against human >= threshold; null where one class is missing.  One pass: scores are counted with the positives of every threshold, and ranked once."""
    rows = df.where(F.col(score).isNotNull() & F.col(human).isNotNull())
    counts = rows.groupBy(score).agg(F.count("*").alias("n"), *[F.count_if(F.col(human) >= t).alias(f"p{k}") for k, t in enumerate(thresholds)])
    rank = F.col("below") + (F.col("n") + 1) / 2
    ranked = running_total(counts, score, "n", "below")
    one = ranked.agg(F.sum("n").alias("n"), *[x for k in range(len(thresholds)) for x in (F.sum(f"p{k}").alias(f"p{k}"), F.sum(F.col(f"p{k}") * rank).alias(f"r{k}"))])
    cell = lambda k, t: F.struct(F.lit(float(t)).alias("threshold"), F.try_divide(F.col(f"r{k}") - F.col(f"p{k}") * (F.col(f"p{k}") + 1) / 2, F.col(f"p{k}") * (F.col("n") - F.col(f"p{k}"))).alias("auc"))
    return one.select(F.explode(F.array(*[cell(k, t) for k, t in enumerate(thresholds)])).alias("r")).select("r.*")


def outcome(truth: Column, prediction: Column) -> Column:
    """tp, fp, fn or tn of a row."""
    return F.when(truth & prediction, "tp").when(prediction, "fp").when(truth, "fn").otherwise("tn")


def confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.groupBy(truth, prediction).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """``class``, precision, recall, f1, support of every class, then accuracy, macro avg and weighted avg."""
    cells = confusion(df.dropna(subset=[truth, prediction]), truth, prediction).select(F.col(truth).cast("string").alias("t"), F.col(prediction).cast("string").alias("p"), "n")
    side = F.explode(F.array(F.struct(F.col("t").alias("class"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))))
    by = cells.select(side.alias("s")).select("s.*").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    per = by.select("class", *_prf(F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")), "support", "tp")
    whole = F.sum("support")
    acc = _ratio(F.sum("tp"), whole)
    rows = [("accuracy", [acc] * 3), ("macro avg", [F.avg(c) for c in ("precision", "recall", "f1")]), ("weighted avg", [_ratio(F.sum(F.col(c) * F.col("support")), whole) for c in ("precision", "recall", "f1")])]
    totals = per.agg(F.array(*[F.struct(F.lit(n).alias("class"), *[m.alias(c) for m, c in zip(ms, ("precision", "recall", "f1"))], whole.alias("support")) for n, ms in rows]).alias("a"))
    return per.drop("tp").unionByName(totals.select(F.explode("a").alias("r")).select("r.*"))


def overall_scores(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row: accuracy, macro_f1, weighted_f1, micro_f1, precision and recall (both macro).  With one label a row, micro-F1 is the accuracy."""
    rows = class_report(df, truth, prediction)
    of = lambda name, column: F.max(F.when(F.col("class") == name, F.col(column)))
    return rows.agg(of("accuracy", "f1").alias("accuracy"), of("macro avg", "f1").alias("macro_f1"), of("weighted avg", "f1").alias("weighted_f1"), of("accuracy", "f1").alias("micro_f1"), of("macro avg", "precision").alias("precision"), of("macro avg", "recall").alias("recall"))


def percent_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.dropna(subset=[a, b]).agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def agreed_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Half the sum of two raters' yes answers."""
    return df.agg(((F.sum(F.col(a).cast("int")) + F.sum(F.col(b).cast("int"))) / 2).alias("agreed"))


def krippendorff_alpha(df: DataFrame, a: str, b: str) -> DataFrame:
    """Nominal alpha of two raters from coincidences; a row one of them left out is not pairable.  1 for perfect agreement, null for a single category or no pairs."""
    pairs = df.dropna(subset=[a, b])
    values = pairs.select(F.explode(F.array(F.col(a).cast("string"), F.col(b).cast("string"))).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    margin = values.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    off = pairs.agg((2 * F.count_if(F.col(a) != F.col(b))).alias("off"))
    alpha = 1 - F.try_divide((F.col("n") - 1) * F.col("off"), F.col("n") * F.col("n") - F.col("squares"))
    return margin.crossJoin(F.broadcast(off)).select(alpha.alias("alpha"))


def gwet_ac1(df: DataFrame, a: str, b: str) -> DataFrame:
    """Gwet's first-order agreement coefficient; null for fewer than two categories."""
    pairs = df.dropna(subset=[a, b])
    values = pairs.select(F.explode(F.array(F.col(a).cast("string"), F.col(b).cast("string"))).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    share = values.crossJoin(F.broadcast(values.agg(F.sum("n").alias("t"), F.count("*").alias("q")))).withColumn("p", F.col("n") / F.col("t"))
    chance = share.agg(F.try_divide(F.sum(F.col("p") * (1 - F.col("p"))), F.max("q") - 1).alias("pe"))
    seen = pairs.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("pa"))
    return chance.crossJoin(F.broadcast(seen)).select(F.try_divide(F.col("pa") - F.col("pe"), 1 - F.col("pe")).alias("ac1"))


def intrusion_accuracy(answers: DataFrame, solutions: DataFrame, by: list[str]) -> DataFrame:
    """Share of right answers by annotator or difficulty; ``by`` empty gives the overall share of all examples."""
    joined = answers.join(solutions.withColumnRenamed("answer", "__right"), "example_id")
    right = F.avg((F.col("answer") == F.col("__right")).cast("double")).alias("accuracy")
    return joined.groupBy(*by).agg(F.count("*").alias("n"), right) if by else joined.agg(F.count("*").alias("n"), right)


def normalize_judgement(value: Column) -> Column:
    """TRUE/FALSE/UNSURE answers and 0 to 5 as numbers: UNSURE and NOT METAPHORICAL count as 0, null stays null, other texts raise."""
    v = F.upper(F.btrim(value))
    bad = F.raise_error(F.concat(F.lit("unknown judgement: "), v)).cast("int")
    return F.when(v.isNull() | (v == ""), F.lit(None).cast("int")).when(v == "TRUE", 1).when(v.isin("FALSE", "UNSURE", "NOT METAPHORICAL"), 0).when(v.rlike("^[0-5]$"), v.try_cast("int")).otherwise(bad)


def rubric(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Composite scores: sums of judgements."""
    for name, parts in groups.items():
        total = normalize_judgement(F.col(parts[0]))
        for p in parts[1:]:
            total = total + normalize_judgement(F.col(p))
        df = df.withColumn(name, total)
    return df


def rubric_means(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """One row: the mean of every composite score, and of every yes-or-no question the share of all rows that say TRUE."""
    asked = [c for c in df.columns if c.endswith("?")]
    said = [F.avg(F.coalesce((F.upper(F.btrim(c)) == "TRUE").cast("double"), F.lit(0.0))).alias(c) for c in asked]
    return rubric(df, groups).agg(*[F.avg(g).alias(g) for g in groups], *said)


# --- clusters


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``label``, ``center``, ``n`` of every cluster; one aggregation with sums on the map side."""
    return df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).groupBy(label).agg(mean_vector(F.col(vector)).alias("center"), F.count("*").alias("n"))


def with_distance(df: DataFrame, label: str, vector: str, centers: DataFrame | None = None, name: str = "d2") -> DataFrame:
    """Rows with the squared distance to their own centre."""
    centers = centers if centers is not None else centroids(df, label, vector)
    return df.join(centers.select(label, "center"), label).withColumn(name, squared_distance(wide(F.col(vector)), F.col("center"))).drop("center")


def within_ss(df: DataFrame, label: str, vector: str, centers: DataFrame | None = None) -> DataFrame:
    return with_distance(df, label, vector, centers).agg(F.sum("d2").alias("wcss"))


def between_ss(df: DataFrame, label: str, vector: str) -> DataFrame:
    whole = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).agg(mean_vector(F.col(vector)).alias("mean"))
    return centroids(df, label, vector).crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * squared_distance(F.col("center"), F.col("mean"))).alias("bcss"))


def calinski_harabasz(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(BCSS / (k - 1)) / (WCSS / (n - k)); null for one cluster or as many as rows."""
    sizes = centroids(df, label, vector).agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    parts = within_ss(df, label, vector).crossJoin(F.broadcast(between_ss(df, label, vector))).crossJoin(F.broadcast(sizes))
    return parts.select(F.try_divide(F.col("bcss") * (F.col("n") - F.col("k")), F.col("wcss") * (F.col("k") - 1)).alias("calinski_harabasz"))


def silhouette(df: DataFrame, ident: str, label: str, vector: str, sample: int | None = None, seed: int = 42, block: int = 1024) -> DataFrame:
    """Mean Euclidean silhouette of all rows, exactly; a lone member counts 0, and so does a single cluster.

    Every row is compared with all others, in pairs of blocks of ``block`` rows sorted by label; a pair gives each row's
    sums of distances per label, which an aggregation adds up.  Time grows with the square of the rows.  ``sample``: only
    a hash sample of so many rows, as its own population; the result is an estimate then.
    """
    from .sampling import draw

    usable = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(ident).alias("i"), F.col(label).cast("string").alias("l"), wide(F.col(vector)).alias("v"))
    if sample is not None:
        usable = draw(usable, "i", sample, seed)
    sizes = usable.groupBy("l").agg(F.count("*").alias("n"))
    n = usable.count()
    near = usable.withColumn("b", F.pmod(F.xxhash64("l"), F.lit(-(-n // block) or 1)))
    place = F.row_number().over(Window.partitionBy("b").orderBy("l", "i", "v")) - 1
    blocks = near.withColumn("c", F.floor(place / block)).groupBy("b", "c").agg(F.array_sort(F.collect_list(F.struct("l", "i", "v"))).alias("m"))
    blocks = blocks.select("b", "c", F.col("m.l").alias("l"), F.flatten("m.v").alias("v"))
    other = blocks.withColumnsRenamed({"b": "b2", "c": "c2", "l": "l2", "v": "v2"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, c, l, v, b2, c2, l2, v2 in pdf.itertuples(index=False):
                x, y = v.reshape(len(l), -1), v2.reshape(len(l2), -1)
                d = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0))
                if (b, c) == (b2, c2):
                    np.fill_diagonal(d, 0)
                first = np.flatnonzero(np.r_[True, l2[1:] != l2[:-1]])
                total = np.add.reduceat(d, first, axis=1)
                yield pd.DataFrame({"b": b, "c": c, "place": np.repeat(np.arange(len(x)), len(first)), "l": np.repeat(l, len(first)), "l2": np.tile(l2[first], len(x)), "d": total.ravel()})

    pairs = blocks.repartition(df.sparkSession.sparkContext.defaultParallelism, "b", "c").crossJoin(other)
    sums = pairs.select("b", "c", "l", "v", "b2", "c2", "l2", "v2").mapInPandas(run, "b BIGINT, c BIGINT, place BIGINT, l STRING, l2 STRING, d DOUBLE")
    means = sums.groupBy("b", "c", "place", "l", "l2").agg(F.sum("d").alias("d")).join(sizes.withColumnRenamed("l", "l2"), "l2")
    same = F.col("l") == F.col("l2")
    rows = means.groupBy("b", "c", "place").agg(F.max(F.when(same & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("d") / F.col("n"))).alias("o"))
    s = F.when(F.col("a").isNull() | F.col("o").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("o") - F.col("a"), F.greatest("a", "o")), F.lit(0.0)))
    return rows.agg(F.avg(s).alias("silhouette"))


def exact_purity(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Share of rows in the largest feature combination of their cluster."""
    cells = df.groupBy(label, *features).agg(F.count("*").alias("n"))
    return cells.groupBy(label).agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg((F.sum("top") / F.sum("n")).alias("purity"))


def feature_purity(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Mean over features of the share of all rows that have their cluster's most frequent value; rows with a null count in the total only."""
    flat = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in features])).alias("x")).select(label, "x.*")
    cells = flat.groupBy(label, "f", "v").agg(F.count("*").alias("n"))
    top = cells.groupBy(label, "f").agg(F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("top"), F.sum("n").alias("n"))
    per = top.groupBy("f").agg((F.coalesce(F.sum("top"), F.lit(0)) / F.sum("n")).alias("purity"))
    return per.agg(F.avg("purity").alias("feature_purity"))
