"""Grids of clusterings and regressions, with one row of measures for each configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .aggregates import document_cluster_wide, document_group_wide, mean_vectors
from .clustering import kmeans, pckmeans
from .ranking import top_share
from .regression import regression


@dataclass(frozen=True)
class Grid:
    """The configurations of an evaluation: every k with plain k-means and with each weight of the constraints."""

    ks: tuple[int, ...] = tuple(range(25, 301, 25))
    weights: tuple[float, ...] = (0.01, 0.05, 0.1)

    def configurations(self) -> list[tuple[int, float | None]]:
        return [(k, w) for k in self.ks for w in (None, *self.weights)]


def quality(labelled: DataFrame, ident: str, vector: str, features: list[str], top: float = 25) -> DataFrame:
    """One row: Calinski-Harabasz index, exact purity of the nearest ``top`` percent and of all members, and feature purity with more than one feature."""
    near = top_share(metrics.with_distance(labelled, "label", vector), "label", [F.col("d2"), F.col(ident)], top)
    out = metrics.calinski_harabasz(labelled, "label", vector)
    out = out.crossJoin(F.broadcast(metrics.exact_purity(near, "label", features).select(F.col("purity").alias("purity_near"))))
    out = out.crossJoin(F.broadcast(metrics.exact_purity(labelled, "label", features).select(F.col("purity").alias("purity_all"))))
    if len(features) > 1:
        return out.crossJoin(F.broadcast(metrics.feature_purity(labelled, "label", features)))
    return out.withColumn("feature_purity", F.lit(None).cast("double"))


def evaluate_grid(df: DataFrame, ident: str, vector: str, features: list[str], doc: str, labels: DataFrame, label: str, grid: Grid, proximity: float | None = None, **regression_options) -> DataFrame:
    """``k``, ``w_cl`` (null for plain k-means), the cluster measures and those of the regression of ``label`` on the documents' cluster counts.

    ``labels`` has ``doc`` and ``label``.  ``proximity`` keeps only the nearest percent of each cluster's members in the counts.
    """
    spark, rows = df.sparkSession, []
    group = F.when(F.forall(F.array(*[F.col(f).isNotNull() for f in features]), lambda x: x), F.concat_ws("|", *features))
    base = df.withColumn("__group", group).drop("label").persist()
    for k, w in grid.configurations():
        if w is None:
            labelled = kmeans(base, vector, k, restarts=3)[0]
        else:
            labelled = base.join(pckmeans(base, ident, vector, "__group", k, w_cl=w)[0], ident)
        labelled = labelled.persist()
        measured = quality(labelled, ident, vector, features).first().asDict()
        counted = top_share(metrics.with_distance(labelled, "label", vector), "label", [F.col("d2"), F.col(ident)], proximity) if proximity else labelled
        wide = document_cluster_wide(counted, labels, doc, "label", k).join(labels.select(doc, label), doc)
        fit = regression(wide, doc, label, **regression_options)
        rows.append((k, w, *[float(measured[c]) if measured[c] is not None else None for c in ("calinski_harabasz", "purity_near", "purity_all", "feature_purity")], *[fit.metrics[c] for c in ("cv_accuracy", "cv_macro_f1", "test_accuracy", "test_macro_f1")]))
        labelled.unpersist()
    base.unpersist()
    return spark.createDataFrame(rows, "k INT, w_cl DOUBLE, calinski_harabasz DOUBLE, purity_near DOUBLE, purity_all DOUBLE, feature_purity DOUBLE, cv_accuracy DOUBLE, cv_macro_f1 DOUBLE, test_accuracy DOUBLE, test_macro_f1 DOUBLE")


def combined_counts(mets: DataFrame, texts: DataFrame, docs: DataFrame, doc: str, met_k: int, text_k: int, target: str | None = None, targets: list[str] | None = None) -> DataFrame:
    """Regression input of metaphor clusters and text clusters together, and counts of target groups if asked for."""
    out = document_cluster_wide(mets, docs, doc, "label", met_k, "Met Cluster ").join(document_cluster_wide(texts, docs, doc, "label", text_k, "Text Cluster "), doc)
    return out.join(document_group_wide(mets, docs, doc, target, targets or []), doc) if target else out


def combined_vectors(texts: DataFrame, mets: DataFrame, doc: str, vector: str, dim: int, how: str = "concat") -> DataFrame:
    """Each document's text vector with the mean of its metaphors' vectors (zeros without any): one after the other, or their mean."""
    from ..functions.vectors import mean_of_two, wide

    means = mean_vectors(mets, texts, doc, vector, dim).withColumnRenamed("vector", "__mean")
    own = wide(F.col(vector))
    both = {"concat": F.concat(own, F.col("__mean")), "mean": mean_of_two(own, F.col("__mean"))}[how]
    return texts.join(means, doc).select(doc, both.alias("vector"))
