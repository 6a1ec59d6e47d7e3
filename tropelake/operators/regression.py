"""Logistic regression on document features, with repeated stratified cross-validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import class_report
from .sampling import bucket, lot


#: Rows of a table for which a fit uses one task.
ROWS_EACH = 20_000


@dataclass
class Fit:
    model: LogisticRegressionModel
    labels: list[str]
    features: list[str]
    metrics: dict[str, float]
    report: DataFrame
    weights: DataFrame


def _scores(predictions: DataFrame) -> tuple[float, float]:
    rows = {r["class"]: r for r in class_report(predictions, "y", "prediction").collect()}  # a row per class
    return rows["accuracy"]["f1"] or 0.0, rows["macro avg"]["f1"] or 0.0  # no rows to predict, no score


def feature_columns(df: DataFrame, include_targets: bool = False) -> list[str]:
    return [c for c in df.columns if "Cluster" in c or (include_targets and c.startswith("Target "))]


def regression(df: DataFrame, ident: str, label: str, include_targets: bool = False, c: float = 0.5, test_percent: int = 20, folds: int = 5, repeats: int = 5, max_iter: int = 1000, seed: int = 42, vector: tuple[str, list[str]] | None = None) -> Fit:
    """L2 logistic regression on standardised features.

    The strength C of n training rows is Spark's regParam 1 / (C n).  The test part is drawn by a hash of the
    identifier; folds are dealt round-robin inside each class, another way in every repeat.  Weights are in the original
    scale of the features.  Rows without a label drop out.  ``vector`` is a vector column, which may be sparse, with the
    names of its places, in place of feature columns.
    """
    names = vector[1] if vector else feature_columns(df, include_targets)
    if not names:
        raise ValueError("no feature columns")
    rows = df.where(F.col(label).isNotNull()).withColumn("label_text", F.col(label).cast("string"))
    indexer = StringIndexer(inputCol="label_text", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    indexed = indexer.transform(rows)
    features = indexed.withColumn("x", F.col(vector[0])) if vector else VectorAssembler(inputCols=names, outputCol="x").transform(indexed)
    table = features.select(ident, "x", "y", (bucket(ident, 100, seed) < test_percent).alias("test")).persist()
    table = table.coalesce(max(1, table.count() // ROWS_EACH)).persist()  # a fit is many short passes
    train, test = table.where("NOT test"), table.where("test")

    def fit(part: DataFrame) -> LogisticRegressionModel:
        n = max(1, part.count())
        return LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / (c * n), elasticNetParam=0.0, standardization=True, maxIter=max_iter).fit(part)

    accuracy, macro = [], []
    for r in range(repeats):
        dealt = train.withColumn("fold", (F.row_number().over(Window.partitionBy("y").orderBy(lot(ident, seed + r))) - 1) % folds).persist()
        for f in range(folds):
            a, m = _scores(fit(dealt.where(F.col("fold") != f)).transform(dealt.where(F.col("fold") == f)))
            accuracy.append(a)
            macro.append(m)
        dealt.unpersist()
    model = fit(train)
    predicted = model.transform(test)
    test_accuracy, test_macro = _scores(predicted)
    metrics = {"cv_accuracy": sum(accuracy) / max(1, len(accuracy)), "cv_macro_f1": sum(macro) / max(1, len(macro)), "test_accuracy": test_accuracy, "test_macro_f1": test_macro}
    matrix = model.coefficientMatrix.toArray()
    classes = indexer.labels if len(matrix) > 1 else indexer.labels[1:]
    weights = [(k, n, float(w)) for k, row in zip(classes, matrix) for n, w in zip(names, row)]
    spark = df.sparkSession
    report = class_report(predicted, "y", "prediction")
    return Fit(model, indexer.labels, names, metrics, report, spark.createDataFrame(weights, "class STRING, feature STRING, weight DOUBLE"))


def run_labels(df: DataFrame, ident: str, labels: list[str], out: str = "", k: int = 0, w_cl: float | None = None, **options) -> DataFrame:
    """Metrics of a regression for each label: ``label``, ``metric``, ``value``.  With ``out`` the reports and weights are kept there, by label, ``k`` and ``w_cl``."""
    from ..sources.results import store_report

    rows = []
    for x in labels:
        fit = regression(df.drop(*[y for y in labels if y != x]), ident, x, **options)
        rows += [(x, m, v) for m, v in fit.metrics.items()]
        if out:
            store_report(fit.report, f"{out}/reports", x, k, w_cl)
            store_report(fit.weights, f"{out}/weights", x, k, w_cl)
    return df.sparkSession.createDataFrame(rows, "label STRING, metric STRING, value DOUBLE")


def run_clusters(assignments: DataFrame, labelled: DataFrame, doc: str, labels: list[str], others: DataFrame | None = None, targets: str | None = None, out: str = "", **options) -> DataFrame:
    """From cluster labels of metaphors (``doc``, ``label``) to regressions of the documents' labels: counts over every cluster that occurs, ``others`` (clusters of the texts) beside them, and counts of the column ``targets`` if asked for."""
    from .aggregates import document_cluster_vectors

    parts = [("Met Cluster " if others is not None else "Cluster ", assignments, "label")]
    parts += [("Text Cluster ", others, "label")] if others is not None else []
    parts += [("Target ", assignments.where(F.col(targets) != ""), targets)] if targets else []
    rows, names, columns = labelled.select(doc, *labels), [], []
    for n, (prefix, table, column) in enumerate(parts):
        counts, values = document_cluster_vectors(table, labelled, doc, column, f"__x{n}")
        rows = rows.join(counts, doc)
        names += [f"{prefix}{v}" for v in values]
        columns.append(f"__x{n}")
    rows = VectorAssembler(inputCols=columns, outputCol="x").transform(rows).drop(*columns) if len(columns) > 1 else rows.withColumnRenamed(columns[0], "x")
    return run_labels(rows, doc, labels, out, len(names), vector=("x", names), **options)
