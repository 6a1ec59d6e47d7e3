"""k-means, seeded k-means and k-means with cannot-link costs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import mean_vector, wide
from .constraints import pairwise_threshold, thresholds, violation_count


def _features(df: DataFrame, vector: str) -> Column:
    """The vectors as ml vectors, which may be sparse already."""
    return F.col(vector) if isinstance(df.schema[vector].dataType, VectorUDT) else array_to_vector(wide(F.col(vector)))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1) - 2 * x @ centers.T, 0)


def kmeans(df: DataFrame, vector: str, k: int, restarts: int = 10, seed: int = 42, max_iter: int = 300) -> tuple[DataFrame, np.ndarray, float]:
    """Rows with a new ``label``, the centres (k × d, on the driver) and the cost of the best of several starts."""
    rows = df.select(_features(df, vector).alias("__v")).persist()
    models = (KMeans(k=k, seed=seed + r, maxIter=max_iter, featuresCol="__v", predictionCol="label").fit(rows) for r in range(restarts))
    best = min(models, key=lambda m: m.summary.trainingCost)
    rows.unpersist()
    labelled = best.transform(df.drop("label").withColumn("__v", _features(df, vector))).drop("__v")
    return labelled, np.array(best.clusterCenters()), float(best.summary.trainingCost)


def best_k(df: DataFrame, ident: str, vector: str, ks: range = range(5, 16), restarts: int = 50, seed: int = 42) -> tuple[int, DataFrame]:
    """The number of clusters with the largest Euclidean silhouette, and its labels."""
    from .metrics import silhouette

    tried = []
    for k in ks:
        labelled = kmeans(df, vector, k, restarts, seed)[0]
        tried.append((silhouette(labelled, ident, "label", vector).first()[0] or 0.0, -k, labelled))
    score, k, labelled = max(tried, key=lambda t: t[:2])
    return -k, labelled


def elbow(df: DataFrame, vector: str, ks: range = range(1, 31), seed: int = 42) -> DataFrame:
    """``k`` and ``inertia``: what an elbow plot shows."""
    rows = df.select(vector).persist()
    cost = lambda k: kmeans(rows, vector, k, 1, seed)[2] if k > 1 else _one_cluster(rows, vector)
    out = df.sparkSession.createDataFrame([(k, cost(k)) for k in ks], "k INT, inertia DOUBLE")
    rows.unpersist()
    return out


def _one_cluster(df: DataFrame, vector: str) -> float:
    """Squared distances to the mean of all: n times the variances' sum."""
    from pyspark.ml.stat import Summarizer

    whole = df.select(_features(df, vector).alias("v")).agg(Summarizer.metrics("variance", "count").summary(F.col("v")).alias("s")).select("s.variance", "s.count").first()
    return float(whole["variance"].toArray().sum() * (whole["count"] - 1))


def nearest_center(df: DataFrame, ident: str, vector: str, centers: np.ndarray) -> DataFrame:
    """``ident``, ``label``, ``d2``: each row's nearest of k centres, which must fit a closure (k × d numbers)."""
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("v")), centers)
                label = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(label.astype(np.int32)), pa.array(d[np.arange(len(d)), label])], names=["i", "label", "d2"])

    rows = df.where(F.col(vector).isNotNull()).select(F.col(ident).alias("i"), wide(F.col(vector)).alias("v"))
    return rows.mapInArrow(run, f"i {kind}, label INT, d2 DOUBLE").withColumnRenamed("i", ident)


SUMS = "label INT, g STRING, n LONG, d2 DOUBLE, sums BINARY"


def _added(parts: DataFrame) -> list:
    """Partial sums of all partitions added up: a row for each label, and for each label and group if there are any."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[:1][["label", "g"]].copy()
        one["n"], one["d2"] = pdf["n"].sum(), pdf["d2"].sum()
        one["sums"] = [np.frombuffer(b"".join(pdf["sums"]), float).reshape(len(pdf), -1).sum(axis=0).tobytes()]
        return one

    return parts.groupBy("label", "g").applyInPandas(add, SUMS).collect()


def _partial(x: np.ndarray, label: np.ndarray, d2: np.ndarray, k: int) -> Iterator[tuple]:
    order = np.argsort(label, kind="stable")
    found, first = np.unique(label[order], return_index=True)
    for c, n, d, s in zip(found, np.diff(np.r_[first, len(label)]), np.add.reduceat(d2[order], first), np.add.reduceat(x[order], first, axis=0)):
        yield int(c), None, int(n), float(d), s.tobytes()


def _sum_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["label", "g", "n", "d2", "sums"])


def lloyd(df: DataFrame, ident: str, vector: str, centers: np.ndarray, max_iter: int = 100, tol: float = 1e-4) -> tuple[DataFrame, np.ndarray]:
    """k-means from given centres; an empty cluster keeps its centre.  A round is one pass that sums where the rows are; labels are made once, at the end."""
    rows = df.where(F.col(vector).isNotNull()).select(wide(F.col(vector)).alias("v")).persist()

    def step(centers: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("v"))
                    d = _distances(x, centers)
                    label = d.argmin(axis=1)
                    yield _sum_batch(list(_partial(x, label, d[np.arange(len(d)), label], len(centers))))

        return run

    for _ in range(max_iter):
        moved = centers.copy()
        for r in _added(rows.mapInArrow(step(centers), SUMS)):
            moved[r["label"]] = np.frombuffer(bytes(r["sums"]), float) / r["n"]
        shift, centers = float(((moved - centers) ** 2).sum()), moved
        if shift < tol:
            break
    rows.unpersist()
    return nearest_center(df, ident, vector, centers), centers


def spread_centers(df: DataFrame, ident: str, vector: str, group: str | None, k: int, w_cl: float, seed: int = 42) -> np.ndarray:
    """Constraint-aware k-means++: the next centre is drawn with weight d² + w_cl · (chosen centres it may not be with).

    One pass per centre, which compares rows with the newest centre only and carries the least distance along; the draw is
    the row with the least -ln(u)/weight (an exponential race), so no prefix sum over all rows is needed.  A null group has
    no constraints.  When all weights are 0 any row not yet taken may come.
    """
    g = F.col(group) if group else F.lit(None).cast("string")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(ident).alias("i"), wide(F.col(vector)).alias("v"), g.cast("string").alias("g"), F.lit(float("inf")).alias("d2")).persist()
    schema = rows.schema
    chosen: list = []

    def nearer(center: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = np.minimum(batch.column("d2").to_numpy(), _distances(_matrix(batch.column("v")), center[None])[:, 0])
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("i", "v", "g")], pa.array(d)], names=["i", "v", "g", "d2"])

        return run

    while len(chosen) < k:
        picked = F.col("i").isin([c["i"] for c in chosen]) if chosen else F.lit(False)
        featured = [c["g"] for c in chosen if c["g"] is not None]
        same = F.coalesce(F.try_element_at(F.create_map(*[x for s in sorted(set(featured)) for x in (F.lit(s), F.lit(featured.count(s)))]), F.col("g")), F.lit(0)) if featured else F.lit(0)
        weight = F.col("d2") + w_cl * F.when(F.col("g").isNotNull(), len(featured) - same).otherwise(0) if chosen else F.lit(1.0)
        u = (F.pmod(F.xxhash64("i", F.lit(seed), F.lit(len(chosen))), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
        race = F.when(picked, None).when(weight > 0, -F.ln(u) / weight).otherwise(1e300 * (1 + u))
        found = rows.withColumn("__r", race).where("__r IS NOT NULL").orderBy("__r", "i").limit(1).collect()
        if not found:
            break
        chosen += found
        last, rows = rows, rows.mapInArrow(nearer(np.array(found[0]["v"])), schema).persist()
        rows.count()
        last.unpersist()
    rows.unpersist()
    return np.array([c["v"] for c in chosen])


def constrained_labels(df: DataFrame, ident: str, vector: str, group: str, centers: np.ndarray, w_cl: float, threshold: float | None = None, gate: float | None = None) -> DataFrame:
    """One assignment pass of constrained k-means: ``i``, ``v``, ``g``, ``label``, ``d2``, ``eligible`` of rows in order of ``ident``, each in the cluster with the least d² + w_cl · (eligible rows before it there with another group).

    A row is eligible when its least d² is at most ``threshold``.  Counting rows per cluster and group replaces the pair
    table.  The order makes the exact pass sequential; it runs in one task that streams sorted batches and holds only
    the counters (k × groups).  With a ``gate`` only rows at most that far away count; the task then holds the vectors of
    all eligible rows.  With ``w_cl`` 0 the pass is parallel; ``pckmeans(parallel=True)`` is the approximation for large tables.
    """
    kind = df.schema[ident].dataType.simpleString()
    k, limit = len(centers), np.inf if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, by = np.zeros(k), {}
        seen: list[tuple] = []  # (vectors, groups, labels) of earlier batches, for the gate
        for batch in batches:
            if not batch.num_rows:
                continue
            x, groups = _matrix(batch.column("v")), batch.column("g").to_pylist()
            d = _distances(x, centers)
            ok = d.min(axis=1) <= limit
            label = d.argmin(axis=1)
            if w_cl:
                mine: list[int] = []
                for n, g in enumerate(groups):
                    if g is None or not ok[n]:
                        continue
                    if gate is None:
                        more = total - by.setdefault(g, np.zeros(k))
                    else:
                        now = (x[mine], np.array([groups[m] for m in mine]), label[mine])
                        more = np.zeros(k)
                        for v, h, c in [*seen, now]:
                            near = (h != g) & (((v - x[n]) ** 2).sum(axis=1) <= gate * gate) if len(v) else np.zeros(0, bool)
                            more += np.bincount(c[near], minlength=k)
                        mine.append(n)
                    label[n] = (d[n] + w_cl * more).argmin()
                    if gate is None:
                        total[label[n]] += 1
                        by[g][label[n]] += 1
                if gate is not None and mine:
                    seen.append((x[mine], np.array([groups[m] for m in mine]), label[mine]))
            columns = [*[batch.column(c) for c in ("i", "v", "g")], pa.array(label.astype(np.int32)), pa.array(d[np.arange(len(d)), label]), pa.array(ok)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "v", "g", "label", "d2", "eligible"])

    rows = df.where(F.col(vector).isNotNull()).select(F.col(ident).alias("i"), wide(F.col(vector)).alias("v"), F.col(group).cast("string").alias("g"))
    if w_cl:
        rows = rows.coalesce(1).sortWithinPartitions("i")
    return rows.mapInArrow(run, f"i {kind}, v ARRAY<DOUBLE>, g STRING, label INT, d2 DOUBLE, eligible BOOLEAN")


class Counters:
    """Eligible rows of every cluster, in all and by group: what an independent assignment needs to know of the last round."""

    def __init__(self, k: int):
        self.total, self.by = np.zeros(k), {}

    def add(self, label: int, g: str, n: int) -> None:
        self.total[label] += n
        self.by.setdefault(g, np.zeros(len(self.total)))[label] += n

    def violations(self) -> int:
        pairs = lambda n: n * (n - 1) / 2
        return int(pairs(self.total).sum() - sum(pairs(n).sum() for n in self.by.values()))


def _jacobi(centers: np.ndarray, w_cl: float, threshold: float | None, known: Counters | None, labels_only: bool):
    """Rows assigned by themselves: every cost counts the eligible rows of the last round, however they are ordered."""
    k, limit = len(centers), np.inf if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, groups = _matrix(batch.column("v")), batch.column("g").to_pylist()
            d = _distances(x, centers)
            bound = (d.min(axis=1) <= limit) & np.array([g is not None for g in groups])
            label = d.argmin(axis=1)
            if known is not None and bound.any():
                extra = np.stack([known.total - known.by.get(g, 0) for g, b in zip(groups, bound) if b])
                label[bound] = (d[bound] + w_cl * extra).argmin(axis=1)
            if labels_only:
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(label.astype(np.int32))], names=["i", "label"])
                continue
            rows = list(_partial(x, label, d[np.arange(len(d)), label], k))
            cells = pd.Series(1, index=[label[bound], [g for g, b in zip(groups, bound) if b]]).groupby(level=[0, 1]).sum() if bound.any() else {}
            rows += [(int(c), g, int(n), 0.0, np.zeros(x.shape[1]).tobytes()) for (c, g), n in cells.items()]
            yield _sum_batch(rows)

    return run


def pckmeans(df: DataFrame, ident: str, vector: str, group: str, k: int, w_cl: float = 0.01, start: str = "kmeans", centroid_percentile: float | None = None, pairwise_percentile: float | None = None, max_iter: int = 100, tol: float = 1e-4, patience: int = 5, parallel: bool = False, seed: int = 42) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """k-means with cannot-link costs: best labels, centres and the history (iteration, inertia, violations, total_cost).

    ``start`` is "kmeans" (best of five) or "spread" (constraint-aware k-means++).  Only rows whose distance to the nearest
    centre is at most the ``centroid_percentile`` have constraints; with a ``pairwise_percentile`` (of the distances in a
    hash sample of 1000 rows) only pairs at most so far apart cost anything.  Inertia is taken against the centres before
    the update, as the cost that the assignment minimised; the best labels are kept, and ``patience`` rounds without a
    better one, or centres that move by less than ``tol``, end the loop.

    The exact pass is sequential (``constrained_labels``).  ``parallel``: every row counts the last round's rows (at first
    those of the nearest centres) in place of those before it, so a round is one pass of independent rows that sums where
    they are; it has no pairwise gate.
    """
    if parallel and pairwise_percentile is not None:
        raise ValueError("the pairwise gate needs the exact pass")
    if start == "kmeans":
        centers = kmeans(df, vector, k, 5, seed)[1]
    else:
        centers = spread_centers(df, ident, vector, group, k, w_cl, seed)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(ident).alias("i"), wide(F.col(vector)).alias("v"), F.col(group).cast("string").alias("g")).persist()
    gate = pairwise_threshold(rows, "i", "v", pairwise_percentile, seed=seed) if pairwise_percentile is not None else None
    history, best, stale, known = [], None, 0, None

    def threshold(centers: np.ndarray) -> float | None:
        return thresholds(nearest_center(rows, "i", "v", centers), "d2", centroid_percentile).first()[0] if centroid_percentile is not None else None

    def counted(found: list, moved: np.ndarray) -> tuple[float, Counters]:
        inertia, counts = 0.0, Counters(len(moved))
        for r in found:
            if r["g"] is None:
                moved[r["label"]] = np.frombuffer(bytes(r["sums"]), float) / r["n"]
                inertia += r["d2"]
            else:
                counts.add(r["label"], r["g"], r["n"])
        return inertia, counts

    if parallel:
        known = counted(_added(rows.mapInArrow(_jacobi(centers, w_cl, threshold(centers), None, False), SUMS)), centers.copy())[1]
    for turn in range(max_iter):
        moved, limit = centers.copy(), threshold(centers)
        if parallel:
            inertia, counts = counted(_added(rows.mapInArrow(_jacobi(centers, w_cl, limit, known, False), SUMS)), moved)
            violations, kept, known = counts.violations(), (centers, limit, known), counts
        else:
            kept = constrained_labels(rows, "i", "v", "g", centers, w_cl, limit, gate).persist()
            stats = kept.groupBy("label").agg(mean_vector(F.col("v")).alias("m"), F.sum("d2").alias("d2")).collect()
            inertia = float(sum(r["d2"] for r in stats))
            for r in stats:
                moved[r["label"]] = r["m"]
            violations = int(violation_count(kept, "label", ["g"], F.col("eligible")).first()[0])
        total = inertia + w_cl * violations
        history.append((turn, inertia, violations, total))
        if best is None or total < best[0]:
            if best is not None and not parallel:
                best[1].unpersist()
            best, stale = (total, kept, moved), 0
        else:
            stale += 1
            if not parallel:
                kept.unpersist()
        shift, centers = float(((moved - centers) ** 2).sum()), moved
        if stale >= patience or (turn and shift < tol):
            break
    if parallel:
        at, limit, counts = best[1]
        kind = df.schema[ident].dataType.simpleString()
        labels = df.where(F.col(vector).isNotNull()).select(F.col(ident).alias("i"), wide(F.col(vector)).alias("v"), F.col(group).cast("string").alias("g")).mapInArrow(_jacobi(at, w_cl, limit, counts, True), f"i {kind}, label INT")
    else:
        labels = best[1].select("i", "label")
    rows.unpersist()
    return labels.withColumnRenamed("i", ident), best[2], df.sparkSession.createDataFrame(history, "iteration INT, inertia DOUBLE, violations LONG, total_cost DOUBLE")


def without_top_components(df: DataFrame, ident: str, vector: str, components: int = 10) -> DataFrame:
    """Unit vectors, centred, without their first principal components.  The d × d covariance is summed on the executors; only it reaches the driver."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    from ..functions.vectors import normalized

    rows = df.select(ident, array_to_vector(normalized(wide(F.col(vector)))).alias("u"))
    mean = np.array(rows.agg(mean_vector(vector_to_array("u")).alias("m")).first()["m"])
    axes = PCA(k=components, inputCol="u", outputCol="p").fit(rows).pc.toArray()
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("u")) - mean
                x -= (x @ axes) @ axes.T
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("i"), lists], names=["i", "vector"])

    flat = rows.select(F.col(ident).alias("i"), vector_to_array("u").alias("u"))
    return flat.mapInArrow(run, f"i {kind}, vector ARRAY<DOUBLE>").withColumnRenamed("i", ident)


def tfidf(df: DataFrame, ident: str, words: str) -> DataFrame:
    """``ident``, ``word``, ``weight``: unit tf-idf with idf = ln((1 + n) / (1 + df)) + 1 over all words, in its sparse form.

    n is the number of rows.  ``ident`` is unique; rows without words give none.
    """
    n = df.agg(F.count("*").alias("n"))
    tf = df.select(F.col(ident).alias("__id"), F.explode(words).alias("word")).groupBy("__id", "word").agg(F.count("*").alias("tf"))
    seen = tf.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    raw = tf.join(seen, "word").select("__id", "word", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy("__id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "__id").select(F.col("__id").alias(ident), "word", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_vectors(weights: DataFrame, ident: str, name: str = "x") -> DataFrame:
    """``ident`` and ``name``, the row's words as a sparse vector over all words that occur."""
    from .ranking import running_total

    places = running_total(weights.select("word").distinct().withColumn("__one", F.lit(1).cast("long")), "word", "__one", "__place").select("word", F.col("__place").cast("int").alias("__place"))
    size = places.count()
    vector = F.udf(lambda m: Vectors.sparse(size, [(r[0], r[1]) for r in m]), VectorUDT())
    entries = weights.join(places, "word").groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("__place", "weight"))).alias("m"))
    return entries.select(ident, vector("m").alias(name))


def word_clusters(df: DataFrame, word: str, k: int, seed: int = 14) -> DataFrame:
    """``label`` and ``word``: distinct phrases, in lower case without outer blanks, clustered by the tf-idf of their words of two letters or more."""
    phrases = df.select(F.lower(F.trim(F.col(word))).alias("word")).where("word IS NOT NULL").distinct()
    weights = tfidf(phrases.select(F.col("word").alias("phrase"), F.expr("regexp_extract_all(word, '(?U)\\\\b\\\\w\\\\w+\\\\b', 0)").alias("w")), "phrase", "w")
    labelled = kmeans(sparse_vectors(weights, "phrase"), "x", k, 1, seed)[0]
    return labelled.select("label", F.col("phrase").alias("word"))
