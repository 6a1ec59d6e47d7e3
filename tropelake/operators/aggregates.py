"""Counts, shares, crosstabs and document features."""

from __future__ import annotations

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of rows by two labels, 0 where there are none; the columns are stated, so that no pass has to find them."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def shares(df: DataFrame, within: list[str], label: str) -> DataFrame:
    """``n`` and ``share`` of each label in its group.  Counts are small before the window sees them."""
    counts = df.groupBy(*within, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def share_difference(df: DataFrame, label: str, population: str, a: str, b: str) -> DataFrame:
    """Per label its share in populations ``a`` and ``b`` and their difference; an empty population counts as one row."""
    counts = df.where(F.col(population).isin(a, b)).groupBy(label).agg(F.count_if(F.col(population) == a).alias("n_a"), F.count_if(F.col(population) == b).alias("n_b"))
    total = counts.agg(F.greatest(F.sum("n_a"), F.lit(1)).alias("t_a"), F.greatest(F.sum("n_b"), F.lit(1)).alias("t_b"))
    out = counts.crossJoin(F.broadcast(total)).select(label, "n_a", "n_b", (F.col("n_a") / F.col("t_a")).alias("share_a"), (F.col("n_b") / F.col("t_b")).alias("share_b"))
    return out.withColumn("difference", F.col("share_a") - F.col("share_b"))


def conditional_share(df: DataFrame, within: list[str], condition: Column) -> DataFrame:
    return df.groupBy(*within).agg(F.avg(condition.cast("double")).alias("share"))


def distinct_per_group(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(F.countDistinct(value).alias("n_distinct"))


def mean_distinct(df: DataFrame, outer: list[str], inner: str, value: str) -> DataFrame:
    """Mean over the ``inner`` groups of their number of distinct values."""
    return distinct_per_group(df, [*outer, inner], value).groupBy(*outer).agg(F.avg("n_distinct").alias("mean_distinct"))


def cluster_counts(df: DataFrame, doc: str, cluster: str) -> DataFrame:
    """Sparse document × cluster counts: ``doc``, ``cluster``, ``n``.  The form for large numbers of clusters."""
    return df.where(F.col(cluster).isNotNull()).groupBy(doc, cluster).agg(F.count("*").alias("n"))


def document_cluster_matrix(df: DataFrame, docs: DataFrame, doc: str, cluster: str, k: int) -> DataFrame:
    """A row for every document with ``counts``, an array of its ``k`` cluster counts; zeros for documents without any.

    Null clusters count for none; a cluster outside 0..k-1 raises, as its rows would be lost.
    """
    bad = F.raise_error(F.concat(F.lit(f"cluster outside 0..{k - 1}: "), F.col(cluster).cast("string"))).cast("int")
    place = F.when(F.col(cluster).between(0, k - 1), F.col(cluster).cast("int")).otherwise(bad)
    entries = cluster_counts(df, doc, cluster).groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct(place, F.col("n").cast("int")))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.coalesce(F.try_element_at(F.col("m"), c), F.lit(0)))
    return docs.select(doc).distinct().join(entries, doc, "left").select(doc, counts.alias("counts"))


def document_cluster_rows(df: DataFrame, docs: DataFrame, doc: str, cluster: str) -> DataFrame:
    """A row for every document with ``clusters``, those it has in order, and their ``counts``; empty for documents without any.

    The matrix over every cluster, in its sparse form: a row is as long as the document has clusters.
    """
    entries = cluster_counts(df, doc, cluster).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("c"), "n"))).alias("e"))
    out = docs.select(doc).distinct().join(entries, doc, "left")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return out.select(doc, F.coalesce(F.col("e.c"), empty(df.schema[cluster].dataType.simpleString())).alias("clusters"), F.coalesce(F.col("e.n"), empty("bigint")).alias("counts"))


def document_cluster_wide(df: DataFrame, docs: DataFrame, doc: str, cluster: str, k: int, prefix: str = "Cluster ") -> DataFrame:
    """The matrix with a column for each cluster, for regressions over a few hundred clusters."""
    matrix = document_cluster_matrix(df, docs, doc, cluster, k)
    return matrix.select(doc, *[F.get("counts", F.lit(c)).alias(f"{prefix}{c}") for c in range(k)])


def document_cluster_vectors(df: DataFrame, docs: DataFrame, doc: str, cluster: str, name: str = "x") -> tuple[DataFrame, list]:
    """A row for every document with ``name``, the sparse vector of its counts over all clusters that occur, and the clusters in the order of the vector's places.

    The driver holds the clusters' numbers, a task one document's counts; the form for regressions over any number of clusters.
    """
    counts = cluster_counts(df, doc, cluster)
    clusters = sorted(r[0] for r in counts.select(cluster).distinct().collect())
    places = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(clusters)], StructType([StructField(cluster, df.schema[cluster].dataType), StructField("__i", IntegerType())]))
    size = len(clusters)
    vector = F.udf(lambda m: Vectors.sparse(size, [(r[0], float(r[1])) for r in m or ()]), VectorUDT())
    entries = counts.join(places, cluster).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("__i", "n"))).alias("m"))
    return docs.select(doc).distinct().join(entries, doc, "left").select(doc, vector("m").alias(name)), clusters


def document_group_wide(df: DataFrame, docs: DataFrame, doc: str, group: str, groups: list[str], prefix: str = "Target ") -> DataFrame:
    """Counts of each stated group per document; empty labels count for none."""
    counts = df.where(F.coalesce(F.col(group), F.lit("")) != "").groupBy(doc).pivot(group, groups).count()
    return docs.select(doc).distinct().join(counts, doc, "left").na.fill(0).withColumnsRenamed({g: f"{prefix}{g}" for g in groups})


def mean_vectors(df: DataFrame, docs: DataFrame, doc: str, vector: str, dim: int) -> DataFrame:
    """Mean of each document's vectors; zeros for a document without any."""
    from ..functions.vectors import mean_vector

    means = df.where(F.col(vector).isNotNull()).groupBy(doc).agg(mean_vector(F.col(vector)).alias("vector"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return docs.select(doc).distinct().join(means, doc, "left").select(doc, F.coalesce("vector", zeros).alias("vector"))


def quartiles(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Exact quartiles with linear interpolation."""
    from .ranking import percentiles

    return percentiles(df, group, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def feature_importance(weights: DataFrame, feature: str = "feature", weight: str = "weight") -> DataFrame:
    """Mean and largest absolute weight of each feature over the classes, ranked by the mean."""
    stats = weights.groupBy(feature).agg(F.avg(F.abs(weight)).alias("mean_abs"), F.max(F.abs(weight)).alias("max_abs"))
    return stats.withColumn("importance_rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), feature)))
