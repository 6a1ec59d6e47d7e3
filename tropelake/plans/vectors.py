"""Vector and cluster-quality queries over ``embeddings`` (label = cluster, a third of the id = feature group)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import constraints, metrics, ranking, relational
from ..operators.clustering import nearest_center
from .registry import query, table

FLAT = """
e AS (SELECT vec_id, label, CAST(vec_id % 3 AS BIGINT) AS g, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings),
f AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e),
m AS (SELECT label, d, avg(x) AS x FROM f GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY d) AS center FROM m GROUP BY label),
own AS (SELECT vec_id, e.label, g, list_distance(v, center) AS dist FROM e JOIN c ON c.label = e.label)
"""


def rows(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3).alias("g"), V.wide(F.col("embedding")).alias("v"))


def measured(spark, sf):
    return metrics.with_distance(rows(spark, sf), "label", "v")


def rounded(column, places=6):
    return F.transform(column, lambda x: F.round(x, places))


@query(f"WITH {FLAT} SELECT label, list_transform(center, lambda x: round(x, 6)) AS center, n FROM c JOIN (SELECT label, count(*) AS n FROM e GROUP BY label) USING (label)")
def centroids(spark, sf):
    return metrics.centroids(rows(spark, sf), "label", "v").select("label", rounded(F.col("center")).alias("center"), "n")


@query(f"WITH {FLAT} SELECT vec_id, round(dist * dist, 6) AS d2 FROM own")
def sq_distance_to_own(spark, sf):
    return measured(spark, sf).select("vec_id", F.round("d2", 6).alias("d2"))


@query(f"WITH {FLAT} SELECT vec_id, CAST(label AS INTEGER) AS label FROM (SELECT e.vec_id, c.label, list_distance(v, center) AS d FROM e, c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, label) = 1")
def nearest_centroid(spark, sf):
    import numpy as np

    base = rows(spark, sf)
    centers = metrics.centroids(base, "label", "v").orderBy("label").collect()  # a row per cluster
    near = nearest_center(base, "vec_id", "v", np.array([r["center"] for r in centers]))
    names = F.array(*[F.lit(r["label"]) for r in centers])
    return near.select("vec_id", F.get(names, "label").alias("label"))


@query(f"WITH {FLAT} SELECT round(sum(dist * dist), 4) AS wcss FROM own")
def wcss(spark, sf):
    return metrics.within_ss(rows(spark, sf), "label", "v").select(F.round("wcss", 4).alias("wcss"))


_BCSS = "(SELECT sum(n * (m.x - w.x) ** 2) FROM m JOIN (SELECT label, count(*) AS n FROM e GROUP BY label) s USING (label) JOIN (SELECT d, avg(x) AS x FROM f GROUP BY d) w USING (d))"


@query(f"WITH {FLAT} SELECT round({_BCSS}, 4) AS bcss")
def bcss(spark, sf):
    return metrics.between_ss(rows(spark, sf), "label", "v").select(F.round("bcss", 4).alias("bcss"))


@query(f"WITH {FLAT}, k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM e) SELECT round({_BCSS} * (n - k) / ((SELECT sum(dist * dist) FROM own) * (k - 1)), 6) AS calinski_harabasz FROM k")
def calinski_harabasz(spark, sf):
    return metrics.calinski_harabasz(rows(spark, sf), "label", "v").select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query(f"""
WITH {FLAT}, s AS (SELECT a.vec_id AS i, a.label AS l, b.label AS m, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
t AS (SELECT i, min(d) FILTER (l = m) AS a, min(d) FILTER (l <> m) AS b FROM s GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM t""")
def silhouette_euclid(spark, sf):
    return metrics.silhouette(rows(spark, sf), "vec_id", "label", "v").select(F.round("silhouette", 6).alias("silhouette"))


def _top_sql(keep):
    return f"WITH {FLAT}, r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round(dist * dist, 9), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM own) SELECT vec_id, label FROM r WHERE r <= {keep}"


def _top(spark, sf, **options):
    order = [F.round("d2", 9), F.col("vec_id")]
    return ranking.top_share(measured(spark, sf), "label", order, 25, **options).select("vec_id", "label")


@query(_top_sql("greatest(1, floor(n * 0.25))"))
def top25_floor(spark, sf):
    return _top(spark, sf)


@query(_top_sql("greatest(1, ceil(n * 0.25))"))
def top25_ceil(spark, sf):
    return _top(spark, sf, rounding="ceil")


@query(_top_sql("floor(n * 0.25)"))
def top25_nomin(spark, sf):
    return _top(spark, sf, at_least_one=False)


@query(f"WITH {FLAT}, q AS (SELECT quantile_cont(dist * dist, 0.5) AS t FROM own) SELECT vec_id, dist * dist <= t + 1e-12 AS eligible FROM own, q")
def centroid_percentile_mask(spark, sf):
    return constraints.eligible_rows(measured(spark, sf), "d2", 50).select("vec_id", "eligible")


@query("SELECT count(*) AS n_constraints FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.vec_id % 3 <> b.vec_id % 3")
def cannot_link_count(spark, sf):
    return constraints.cannot_link_count(rows(spark, sf), ["g"])


_PAIRS = "embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND a.vec_id % 3 <> b.vec_id % 3"


@query(f"SELECT a.label, count(*) AS violations FROM {_PAIRS} GROUP BY a.label")
def violations_closed(spark, sf):
    return constraints.violations_by_cluster(rows(spark, sf), "label", ["g"])


@query(f"SELECT a.label, a.vec_id AS i, b.vec_id AS j FROM {_PAIRS}")
def violations_pairs(spark, sf):
    return relational.different_pairs(rows(spark, sf), "vec_id", ["label"], ["g"])


def _history(spark, sf):
    """Violations under two iterations with different labels."""
    base = rows(spark, sf)
    turns = [relational.different_pairs(base.withColumn("l", label), "vec_id", ["l"], ["g"]).select("i", "j", F.lit(n).alias("iteration")) for n, label in enumerate((F.col("label").cast("long"), F.col("vec_id") % 5))]
    return turns[0].unionByName(turns[1])


@query(f"SELECT least(a.vec_id, b.vec_id) AS i, greatest(a.vec_id, b.vec_id) AS j FROM {_PAIRS} AND a.vec_id % 5 = b.vec_id % 5")
def persistent_violations(spark, sf):
    """Violations that both iterations have."""
    return constraints.persistent_pairs(_history(spark, sf))


_TURNS = "h AS (SELECT a.vec_id AS i, b.vec_id AS j, (a.label = b.label)::INT + (a.vec_id % 5 = b.vec_id % 5)::INT AS n_iterations FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.vec_id % 3 <> b.vec_id % 3 AND (a.label = b.label OR a.vec_id % 5 = b.vec_id % 5))"


@query(f"WITH {_TURNS} SELECT n_iterations, n_iterations / 2 AS frequency, count(*) AS n_pairs FROM h GROUP BY ALL")
def violation_frequency(spark, sf):
    """How many pairs occur in how many iterations."""
    return constraints.violation_frequency(_history(spark, sf)).groupBy(F.col("n_iterations").cast("int").alias("n_iterations"), "frequency").agg(F.count("*").alias("n_pairs"))


@query(f"WITH {_TURNS} SELECT i, j, CAST(n_iterations AS BIGINT) AS n_iterations, n_iterations / 2 AS frequency FROM h ORDER BY n_iterations DESC, i, j LIMIT 10")
def most_violated(spark, sf):
    return constraints.most_violated(_history(spark, sf))


@query(f"WITH {_TURNS.replace('h AS', 'unused AS')}, c AS (SELECT count(*) FILTER (a.label = b.label) AS x, count(*) FILTER (a.vec_id % 5 = b.vec_id % 5) AS y FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.vec_id % 3 <> b.vec_id % 3) SELECT CASE WHEN y < x THEN 'decreasing' ELSE 'increasing' END AS trend FROM c")
def violation_trend(spark, sf):
    """From one iteration to the other, by counts in closed form."""
    base = rows(spark, sf)
    counts = [constraints.violation_count(base.withColumn("l", label), "l", ["g"]).withColumn("iteration", F.lit(n)) for n, label in enumerate((F.col("label").cast("long"), F.col("vec_id") % 5))]
    return constraints.violation_trend(counts[0].unionByName(counts[1]))


@query("WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id LIMIT 1000) SELECT round(quantile_cont(list_distance(a.v, b.v), 0.1), 6) AS threshold FROM s a JOIN s b ON a.vec_id < b.vec_id")
def pairwise_threshold(spark, sf):
    """The tenth percentile of the distances in a sample of at most 1000 rows, which is the operator's definition."""
    return spark.createDataFrame([(round(constraints.pairwise_threshold(rows(spark, sf), "vec_id", "v", 10), 6),)], "threshold DOUBLE")


@query(f"WITH {FLAT}, x AS (SELECT label, g, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT label, max(n) AS top, sum(n) AS n FROM x GROUP BY label) SELECT round(sum(top) / sum(n), 9) AS purity FROM t")
def purity_100(spark, sf):
    return metrics.exact_purity(rows(spark, sf), "label", ["g"]).select(F.round("purity", 9).alias("purity"))


@query(f"""
WITH {FLAT}, r AS (SELECT label, g, row_number() OVER (PARTITION BY label ORDER BY round(dist * dist, 9), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM own),
x AS (SELECT label, g, count(*) AS n FROM r WHERE r <= greatest(1, floor(n * 0.25)) GROUP BY ALL), t AS (SELECT label, max(n) AS top, sum(n) AS n FROM x GROUP BY label)
SELECT round(sum(top) / sum(n), 9) AS purity FROM t""")
def purity_25(spark, sf):
    near = ranking.top_share(measured(spark, sf), "label", [F.round("d2", 9), F.col("vec_id")], 25)
    return metrics.exact_purity(near, "label", ["g"]).select(F.round("purity", 9).alias("purity"))


@query("""
WITH e AS (SELECT label, vec_id % 3 AS g, CASE WHEN vec_id % 7 > 0 THEN vec_id % 2 END AS h FROM embeddings),
x AS (SELECT label, 'g' AS f, g AS v, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT label, 'h', h, count(*) FROM e GROUP BY ALL),
t AS (SELECT label, f, max(n) FILTER (v IS NOT NULL) AS top, sum(n) AS n FROM x GROUP BY ALL), p AS (SELECT f, sum(top) / sum(n) AS p FROM t GROUP BY f)
SELECT round(avg(p), 9) AS feature_purity FROM p""")
def feature_purity(spark, sf):
    base = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 3).alias("g"), F.when(F.col("vec_id") % 7 > 0, F.col("vec_id") % 2).alias("h"))
    return metrics.feature_purity(base, "label", ["g", "h"]).select(F.round("feature_purity", 9).alias("feature_purity"))


@query(f"""
WITH {FLAT}, p AS (SELECT a.label, b.label AS other, list_distance(a.center, b.center) AS d FROM c a JOIN c b ON a.label <> b.label),
r AS (SELECT label, other, row_number() OVER (PARTITION BY label ORDER BY d, other) AS r, count(*) OVER (PARTITION BY label) AS n FROM p)
SELECT label, other, 'easy' AS kind FROM r WHERE r > n - greatest(1, floor(n * 0.25)) UNION ALL SELECT label, other, 'medium' FROM r WHERE r <= greatest(1, floor(n * 0.25)) UNION ALL SELECT label, other, 'hard' FROM r WHERE r = 1""")
def cluster_rank_far_near(spark, sf):
    from ..operators import intrusion

    return intrusion.far_or_near(intrusion.cluster_distances(metrics.centroids(rows(spark, sf), "label", "v")))


@query(f"WITH {FLAT} SELECT a.vec_id, list_transform(list_zip(a.v, c.center), lambda z: round((z[1] + z[2]) / 2, 6)) AS v FROM e a JOIN c ON c.label = a.label")
def mean_vectors(spark, sf):
    joined = rows(spark, sf).join(metrics.centroids(rows(spark, sf), "label", "v").drop("n"), "label")
    return joined.select("vec_id", rounded(V.mean_of_two(F.col("v"), F.col("center"))).alias("v"))


@query(f"WITH {FLAT} SELECT a.vec_id, len(list_concat(a.v, c.center)) AS size, round(list_sum(list_concat(a.v, c.center)), 5) AS total FROM e a JOIN c ON c.label = a.label")
def concat_vectors(spark, sf):
    joined = rows(spark, sf).join(metrics.centroids(rows(spark, sf), "label", "v").drop("n"), "label")
    both = F.concat("v", "center")
    return joined.select("vec_id", F.size(both).cast("long").alias("size"), F.round(F.aggregate(both, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"WITH {FLAT}, docs AS (SELECT unnest(range(12)) AS label) SELECT CAST(d.label AS INTEGER) AS label, coalesce(list_transform(center, lambda x: round(x, 6)), list_transform(range(64), lambda i: 0.0::DOUBLE)) AS vector FROM docs d LEFT JOIN c ON c.label = d.label")
def mean_vector_by_label(spark, sf):
    """Means per document, zeros for a document without vectors."""
    from ..operators.aggregates import mean_vectors as means

    docs = spark.range(12).select(F.col("id").cast("int").alias("label"))
    return means(rows(spark, sf), docs, "label", "v", 64).select("label", rounded(F.col("vector")).alias("vector"))


@query(f"WITH {FLAT} SELECT vec_id, label, round(list_inner_product(v, center), 6) AS dot FROM e JOIN c USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(list_inner_product(v, center), 9) DESC, vec_id) <= 10")
def proximity_order(spark, sf):
    """Members closest to their centre by dot product."""
    joined = rows(spark, sf).join(metrics.centroids(rows(spark, sf), "label", "v").drop("n"), "label").withColumn("dot", V.dot(F.col("v"), F.col("center")))
    return ranking.first_n(joined, ["label"], [F.desc(F.round("dot", 9)), F.col("vec_id")], 10).select("vec_id", "label", F.round("dot", 6).alias("dot"))


@query(f"WITH {FLAT} SELECT vec_id, round(list_inner_product(v, v), 6) AS norm2 FROM e")
def squared_norms(spark, sf):
    return rows(spark, sf).select("vec_id", F.round(V.dot(F.col("v"), F.col("v")), 6).alias("norm2"))
