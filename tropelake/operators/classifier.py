"""A classifier of words in their sentences: provider vectors, a trained layer on top, folds or a held-out group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import mean_of_two, wide
from .features import embed, word_vectors
from .metrics import class_report, overall_scores
from .sampling import bucket


def span_vectors(df: DataFrame, ident: str, text: str, word: str, words: Callable, embedder: Callable) -> DataFrame:
    """``id`` and ``v``: the vector of the word in its sentence and that of the whole sentence, pooled to their mean."""
    spans = word_vectors(df, ident, text, word, words)
    whole = embed(df, ident, text, embedder).select("id", F.col("emb").alias("whole"))
    return spans.join(whole, "id").select("id", mean_of_two(wide(F.col("emb")), wide(F.col("whole"))).alias("v"))


def evaluate(df: DataFrame, ident: str, vector: str, label: str, folds: int = 5, group: str | None = None, c: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Reports (``fold``, class, precision, …) and scores (``fold``, accuracy, macro_f1, …) of a classifier trained on the other folds.

    Folds are dealt by a hash of the identifier, or, with ``group``, each of its values is left out once.  Labels are
    integers from 0.  A fold without rows to train on or to predict gives none.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(ident), array_to_vector(wide(F.col(vector))).alias("x"), F.col(label).cast("double").alias("y"), (F.col(group).cast("string") if group else bucket(ident, folds, seed).cast("string")).alias("fold")).persist()
    reports, scores = None, None
    for (fold,) in sorted(rows.select("fold").where("fold IS NOT NULL").distinct().collect()):
        train = rows.where(~F.col("fold").eqNullSafe(fold))
        n = train.count()
        if not n:
            continue
        model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / (c * n), maxIter=200).fit(train)
        predicted = model.transform(rows.where(F.col("fold") == fold)).select(F.col("y").cast("int").alias("t"), F.col("prediction").cast("int").alias("p"))
        one, two = class_report(predicted, "t", "p").withColumn("fold", F.lit(fold)), overall_scores(predicted, "t", "p").withColumn("fold", F.lit(fold))
        reports, scores = (one, two) if reports is None else (reports.unionByName(one), scores.unionByName(two))
    if reports is None:
        raise ValueError("no fold has rows to train on")
    return reports, scores
