"""Case-study queries over the cluster export (one row per metaphor) and the episodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import relational
from .registry import query, table

FACTS = """
facts AS (SELECT met_id, distance, cluster, polarity, doc_year, channel, duration, target_group, target_ppto, source_image_schema_group AS schema_group, episode FROM clust_export
          QUALIFY row_number() OVER (PARTITION BY met_id ORDER BY exported_at DESC) = 1),
pod AS (SELECT * FROM facts WHERE episode IS NOT NULL AND cluster >= 0)
"""
YEARS = list(range(2022, 2027))
SIDES = ["left", "right"]
SCHEMAS = ["spatial motion", "force", "balance", "other"]


def facts(spark, sf):
    """The latest export of every metaphor."""
    rows = relational.keep_first(table(spark, sf, "clust_export"), ["met_id"], [F.desc("exported_at")])
    return rows.withColumnRenamed("source_image_schema_group", "schema_group")


def pod(spark, sf):
    return facts(spark, sf).where("episode IS NOT NULL AND cluster >= 0")


@query(f"WITH {FACTS} SELECT channel, doc_year, polarity, count(*) AS n FROM pod GROUP BY ALL")
def coverage_counts(spark, sf):
    return pod(spark, sf).groupBy("channel", "doc_year", "polarity").agg(F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT channel, " + ", ".join(f"count(*) FILTER (doc_year = {y}) AS \"{y}\"" for y in YEARS) + " FROM pod GROUP BY channel")
def channel_year_matrix(spark, sf):
    return A.crosstab(pod(spark, sf), "channel", "doc_year", YEARS)


@query(f"WITH {FACTS}, e AS (SELECT episode, min(channel) AS channel, min(duration) AS duration FROM pod GROUP BY episode) SELECT channel, round(avg(duration) / 60, 6) AS mean_minutes FROM e GROUP BY channel")
def dedupe_mean_value(spark, sf):
    """Mean duration per channel, each episode once."""
    once = pod(spark, sf).groupBy("episode").agg(F.min("channel").alias("channel"), F.min("duration").alias("duration"))
    return once.groupBy("channel").agg(F.round(F.avg("duration") / 60, 6).alias("mean_minutes"))


@query(f"""
WITH {FACTS}, top AS (SELECT target_group FROM pod WHERE target_group IS NOT NULL AND lower(target_group) <> 'other' GROUP BY ALL ORDER BY count(*) DESC, target_group LIMIT 10)
SELECT target_group, count(*) FILTER (polarity = 'left') AS "left", count(*) FILTER (polarity = 'right') AS "right" FROM pod SEMI JOIN top USING (target_group) GROUP BY target_group""")
def top_groups_by_polarity(spark, sf):
    rows = pod(spark, sf).where("target_group IS NOT NULL AND lower(target_group) <> 'other'")
    top = rows.groupBy("target_group").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_group").limit(10)
    return A.crosstab(rows.join(top, "target_group", "left_semi"), "target_group", "polarity", SIDES)


def _difference(spark, sf, label):
    d = A.share_difference(pod(spark, sf).where(F.col(label).isNotNull()), label, "polarity", "left", "right")
    return d.withColumns({c: F.round(c, 9) for c in ("share_a", "share_b", "difference")})


def _difference_sql(label):
    return f"""
WITH {FACTS}, c AS (SELECT {label}, count(*) FILTER (polarity = 'left') AS n_a, count(*) FILTER (polarity = 'right') AS n_b FROM pod WHERE {label} IS NOT NULL AND polarity IN ('left', 'right') GROUP BY ALL),
t AS (SELECT greatest(sum(n_a), 1) AS t_a, greatest(sum(n_b), 1) AS t_b FROM c)
SELECT {label}, n_a, n_b, round(n_a / t_a, 9) AS share_a, round(n_b / t_b, 9) AS share_b, round(n_a / t_a - n_b / t_b, 9) AS difference FROM c, t"""


@query(f"SELECT * FROM ({_difference_sql('target_group')}) ORDER BY abs(difference) DESC, target_group LIMIT 10")
def divisive_groups(spark, sf):
    return _difference(spark, sf, "target_group").orderBy(F.desc(F.abs("difference")), "target_group").limit(10)


@query(_difference_sql("cluster"))
def cluster_polarity_difference(spark, sf):
    return _difference(spark, sf, "cluster")


@query(f"WITH {FACTS}, e AS (SELECT doc_year, polarity, episode, count(DISTINCT cluster) AS n FROM pod GROUP BY ALL) SELECT doc_year, polarity, round(avg(n), 6) AS mean_distinct FROM e GROUP BY ALL")
def avg_distinct_by_year(spark, sf):
    return A.mean_distinct(pod(spark, sf), ["doc_year", "polarity"], "episode", "cluster").withColumn("mean_distinct", F.round("mean_distinct", 6))


@query(f"WITH {FACTS} SELECT episode, min(channel) AS channel, min(duration) AS duration, min(doc_year) AS doc_year, min(polarity) AS polarity, count(DISTINCT cluster) AS n_clusters FROM pod GROUP BY episode")
def distinct_per_episode(spark, sf):
    return pod(spark, sf).groupBy("episode").agg(*[F.min(c).alias(c) for c in ("channel", "duration", "doc_year", "polarity")], F.countDistinct("cluster").alias("n_clusters"))


@query(f"WITH {FACTS}, e AS (SELECT channel, episode, count(DISTINCT cluster) AS n FROM pod GROUP BY ALL) SELECT channel, round(avg(n), 6) AS mean_distinct FROM e GROUP BY channel")
def avg_distinct_by_channel(spark, sf):
    return A.mean_distinct(pod(spark, sf), ["channel"], "episode", "cluster").withColumn("mean_distinct", F.round("mean_distinct", 6))


def _row_share(rows, label, column, values):
    counts = A.crosstab(rows, label, column, values)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return counts.select(label, *[F.round(F.coalesce(F.try_divide(F.col(f"`{v}`"), total), F.lit(0.0)), 9).alias(v) for v in values])


def _row_share_sql(label, column, values, rows="pod"):
    total = f"nullif(count(*) FILTER ({column} IN (" + ", ".join(f"'{v}'" for v in values) + ")), 0)"
    return f"SELECT {label}, " + ", ".join(f"round(coalesce(count(*) FILTER ({column} = '{v}') / {total}, 0), 9) AS \"{v}\"" for v in values) + f" FROM {rows} GROUP BY {label}"


@query(f"WITH {FACTS} " + _row_share_sql("polarity", "schema_group", SCHEMAS))
def crosstab_rowshare(spark, sf):
    """Mix of image schemas by polarity."""
    return _row_share(pod(spark, sf), "polarity", "schema_group", SCHEMAS)


@query(f"WITH {FACTS} SELECT schema_group, count(*) FILTER (polarity = 'left') AS \"left\", count(*) FILTER (polarity = 'right') AS \"right\" FROM pod GROUP BY schema_group")
def crosstab_counts(spark, sf):
    return A.crosstab(pod(spark, sf), "schema_group", "polarity", SIDES)


@query(f"WITH {FACTS}, c AS (SELECT doc_year, schema_group, count(*) AS n FROM pod GROUP BY ALL) SELECT doc_year, schema_group, n, round(n / sum(n) OVER (PARTITION BY doc_year), 9) AS share FROM c")
def share_over_time(spark, sf):
    return A.shares(pod(spark, sf), ["doc_year"], "schema_group").withColumn("share", F.round("share", 9))


@query(f"WITH {FACTS} SELECT cluster, doc_year, count(*) AS n FROM pod WHERE cluster IN (17, 100, 114) GROUP BY ALL")
def cluster_trend(spark, sf):
    return pod(spark, sf).where(F.col("cluster").isin(17, 100, 114)).groupBy("cluster", "doc_year").agg(F.count("*").alias("n"))


PPTO = ["person", "place", "thing", "organization"]


@query(f"WITH {FACTS} " + _row_share_sql("polarity", "target_ppto", PPTO))
def noun_type_by_polarity(spark, sf):
    return _row_share(pod(spark, sf), "polarity", "target_ppto", PPTO)


@query(f"WITH {FACTS}, c AS (SELECT doc_year, target_ppto, count(*) AS n FROM pod GROUP BY ALL) SELECT doc_year, target_ppto, n, round(n / sum(n) OVER (PARTITION BY doc_year), 9) AS share FROM c")
def noun_type_over_time(spark, sf):
    return A.shares(pod(spark, sf), ["doc_year"], "target_ppto").withColumn("share", F.round("share", 9))


@query(f"WITH {FACTS}, r AS (SELECT * FROM pod WHERE schema_group <> 'other' AND polarity = 'left') " + _row_share_sql("schema_group", "target_ppto", PPTO, "r"))
def schema_by_noun_type(spark, sf):
    return _row_share(pod(spark, sf).where("schema_group <> 'other' AND polarity = 'left'"), "schema_group", "target_ppto", PPTO)


@query(f"WITH {FACTS} SELECT doc_year, channel, count(DISTINCT cluster) AS n_distinct FROM pod GROUP BY ALL")
def channel_diversity(spark, sf):
    return A.distinct_per_group(pod(spark, sf), ["doc_year", "channel"], "cluster")


@query(f"WITH {FACTS} " + _row_share_sql("channel", "schema_group", SCHEMAS))
def channel_schema_share(spark, sf):
    return _row_share(pod(spark, sf), "channel", "schema_group", SCHEMAS)


@query(f"WITH {FACTS} " + _row_share_sql("channel", "target_ppto", PPTO))
def channel_noun_type_share(spark, sf):
    return _row_share(pod(spark, sf), "channel", "target_ppto", PPTO)


@query(f"WITH {FACTS} SELECT channel, doc_year, round(avg(CASE WHEN schema_group = 'force' THEN 1.0 WHEN schema_group IS NOT NULL THEN 0.0 END), 9) AS share FROM pod GROUP BY ALL")
def conditional_share(spark, sf):
    return A.conditional_share(pod(spark, sf), ["channel", "doc_year"], F.col("schema_group") == "force").withColumn("share", F.round("share", 9))


@query(f"WITH {FACTS}, y AS (SELECT count(DISTINCT doc_year) AS n FROM pod) SELECT channel FROM pod GROUP BY channel HAVING count(DISTINCT doc_year) = (SELECT n FROM y)")
def full_coverage_channels(spark, sf):
    return relational.full_coverage(pod(spark, sf), "channel", "doc_year")


@query(f"""
WITH {FACTS}, full_ AS (SELECT channel FROM pod GROUP BY channel HAVING count(DISTINCT doc_year) = (SELECT count(DISTINCT doc_year) FROM pod)),
d AS (SELECT doc_year, channel, count(DISTINCT cluster) AS n FROM pod SEMI JOIN full_ USING (channel) GROUP BY ALL)
SELECT doc_year, round(avg(n), 6) AS mean_distinct FROM d GROUP BY doc_year""")
def diversity_trend(spark, sf):
    rows = pod(spark, sf)
    full = relational.only(rows, relational.full_coverage(rows, "channel", "doc_year"), ["channel"])
    return A.mean_distinct(full, ["doc_year"], "channel", "cluster").withColumn("mean_distinct", F.round("mean_distinct", 6))


_YEAR = r"CASE WHEN regexp_full_match(translate(string_split(episode_date, 'T')[1], '/', '-'), '\d{4}-\d{2}-\d{2}') THEN CAST(year(try_cast(translate(string_split(episode_date, 'T')[1], '/', '-') AS DATE)) AS INTEGER) END"
EPISODES = f"e AS (SELECT episode, min(title) AS title, min(author) AS author, min(channel) AS channel, min(polarity) AS polarity, min({_YEAR}) AS year, min(duration) AS duration FROM episodes GROUP BY episode)"


def episodes(spark, sf):
    """One row per episode, with its year."""
    rows = table(spark, sf, "episodes").withColumn("year", T.year_of(F.col("episode_date")))
    return rows.groupBy("episode").agg(*[F.min(c).alias(c) for c in ("title", "author", "channel", "polarity", "year", "duration")])


@query(f"WITH {EPISODES} SELECT * FROM e")
def episode_metadata(spark, sf):
    return episodes(spark, sf)


@query(f"WITH {EPISODES} SELECT year, channel, count(*) AS n_episodes, round(sum(duration), 3) AS seconds, round(avg(duration) / 60, 6) AS mean_minutes FROM e GROUP BY ALL")
def episodes_per_year(spark, sf):
    return episodes(spark, sf).groupBy("year", "channel").agg(F.count("*").alias("n_episodes"), F.round(F.sum("duration"), 3).alias("seconds"), F.round(F.avg("duration") / 60, 6).alias("mean_minutes"))


@query(f"WITH {EPISODES} SELECT channel, " + ", ".join(f"count(*) FILTER (year = {y}) AS \"{y}\"" for y in YEARS) + " FROM e GROUP BY channel")
def podcast_year_matrix(spark, sf):
    return A.crosstab(episodes(spark, sf), "channel", "year", YEARS)


@query(f"WITH {FACTS} SELECT source_word, n FROM (SELECT target_group AS source_word, count(*) AS n FROM facts GROUP BY ALL) ORDER BY n DESC, source_word LIMIT 20")
def value_counts_topn(spark, sf):
    return facts(spark, sf).groupBy(F.col("target_group").alias("source_word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("source_word")).limit(20)


@query(f"WITH {FACTS}, d AS (SELECT string_split(met_id, '_')[1] AS doc, count(*) AS n FROM facts GROUP BY ALL) SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_mets, round(avg(n), 6) AS mean_mets FROM d")
def corpus_statistics(spark, sf):
    per = facts(spark, sf).groupBy(F.substring_index("met_id", "_", 1).alias("doc")).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_mets"), F.round(F.avg("n"), 6).alias("mean_mets"))


@query(f"WITH {FACTS} SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders GROUP BY ALL")
def year_count(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query(f"WITH {FACTS}, c AS (SELECT episode, cluster, count(*) AS n FROM pod GROUP BY ALL) SELECT episode, list(cluster ORDER BY cluster) AS clusters, list(n ORDER BY cluster) AS counts FROM c GROUP BY episode")
def doc_cluster_matrix(spark, sf):
    """Counts over every cluster that occurs, in sparse rows."""
    rows = pod(spark, sf)
    return A.document_cluster_rows(rows, rows, "episode", "cluster")


@query(f"""WITH {FACTS} SELECT episode, count(*) FILTER (target_group = 'Immigrants') AS "Target Immigrants", count(*) FILTER (target_group = 'Police') AS "Target Police" FROM pod GROUP BY episode""")
def doc_cluster_group_matrix(spark, sf):
    rows = pod(spark, sf)
    return A.document_group_wide(rows, rows, "episode", "target_group", ["Immigrants", "Police"])


@query(f"WITH {FACTS} SELECT episode, cluster, count(*) AS n FROM pod GROUP BY ALL")
def doc_cluster_sparse(spark, sf):
    return A.cluster_counts(pod(spark, sf), "episode", "cluster")


@query(f"WITH {FACTS}, w AS (SELECT cluster AS feature, round(abs(avg(distance)), 6) AS weight FROM pod WHERE distance IS NOT NULL AND NOT isnan(distance) GROUP BY ALL) SELECT feature, round(weight, 6) AS mean_abs, round(weight, 6) AS max_abs, CAST(row_number() OVER (ORDER BY weight DESC, feature) AS INTEGER) AS importance_rank FROM w")
def cluster_importance(spark, sf):
    """Clusters ranked by a weight of each; the weights are few, one per cluster and class."""
    weights = pod(spark, sf).where("distance IS NOT NULL AND NOT isnan(distance)").groupBy(F.col("cluster").alias("feature")).agg(F.round(F.avg("distance"), 6).alias("weight"))
    return A.feature_importance(weights)


@query(f"WITH {FACTS}, g AS (SELECT target_ppto, target_group, min(schema_group) AS d FROM facts WHERE target_ppto IS NOT NULL AND target_group IS NOT NULL GROUP BY ALL) SELECT target_ppto AS noun_type, count(*) AS n FROM g GROUP BY ALL")
def group_dictionary_sizes(spark, sf):
    from ..operators.features import group_dictionary

    rows = facts(spark, sf).where("target_ppto IS NOT NULL AND target_group IS NOT NULL").select(F.col("target_ppto").alias("noun_type"), "target_group", F.col("schema_group").alias("definition"))
    return group_dictionary(rows).select("noun_type", F.size("groups").cast("long").alias("n"))


@query(f"WITH {FACTS}, g AS (SELECT target_ppto, target_group, min(schema_group) AS d FROM facts WHERE target_ppto IS NOT NULL AND target_group IS NOT NULL GROUP BY ALL) SELECT target_ppto AS noun_type, string_agg(target_group || ': ' || coalesce(d, ''), chr(10) ORDER BY target_group) AS text FROM g GROUP BY ALL")
def group_dictionary_text(spark, sf):
    from ..operators.features import group_text

    rows = facts(spark, sf).where("target_ppto IS NOT NULL AND target_group IS NOT NULL").select(F.col("target_ppto").alias("noun_type"), "target_group", F.col("schema_group").alias("definition"))
    return group_text(rows)


@query("WITH d AS (SELECT string_split(id, '_')[1] AS doc, count(DISTINCT id) AS n, count(DISTINCT sent_idx) AS s FROM llm_met_scores GROUP BY ALL) SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_candidates, round(avg(n), 6) AS mean_candidates, round(avg(s), 6) AS mean_sentences FROM d")
def candidate_statistics(spark, sf):
    """Documents with candidates, candidates, and their and their sentences' mean number per document."""
    per = table(spark, sf, "llm_met_scores").groupBy(F.substring_index("id", "_", 1).alias("doc")).agg(F.countDistinct("id").alias("n"), F.countDistinct("sent_idx").alias("s"))
    return per.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_candidates"), F.round(F.avg("n"), 6).alias("mean_candidates"), F.round(F.avg("s"), 6).alias("mean_sentences"))
