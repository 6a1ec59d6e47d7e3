"""Evaluation metrics over scores, annotations and events (rater a and b, truth and prediction by arithmetic on ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import metrics
from .registry import query, table

GOLD = """
h AS (SELECT document_id, max(try_cast(annotation_value AS DOUBLE)) AS human FROM doc_annotations WHERE annotation_type = 'human_metaphor_score' GROUP BY document_id),
s AS (SELECT regexp_replace(doc_id, '^(.{36})-[0-9]+$', '\\1') AS document_id, avg(llm_met_score) AS score FROM llm_met_scores WHERE llm_met_score BETWEEN 0 AND 1 GROUP BY ALL),
j AS (SELECT document_id, human, coalesce(score, 0) AS score, coalesce(score, 0) >= 0.3 AS ours FROM h LEFT JOIN s USING (document_id))
"""


def judged(spark, sf):
    """Human scores with the mean score of the document, 0 where there is none."""
    human = table(spark, sf, "doc_annotations").where("annotation_type = 'human_metaphor_score'").groupBy("document_id").agg(F.max(F.col("annotation_value").try_cast("double")).alias("human"))
    scores = table(spark, sf, "llm_met_scores").where("llm_met_score BETWEEN 0 AND 1").groupBy(ids.strip_episode_chunk(F.col("doc_id")).alias("document_id")).agg(F.avg("llm_met_score").alias("score"))
    return human.join(scores, "document_id", "left").fillna({"score": 0.0}).withColumn("ours", F.col("score") >= 0.3)


@query(f"WITH {GOLD} SELECT document_id, human, round(score, 9) AS score FROM j")
def human_with_mean_score(spark, sf):
    return judged(spark, sf).select("document_id", "human", F.round("score", 9).alias("score"))


THRESHOLDS = [t / 10 for t in range(1, 11)]
_PRF = """round_even(100 * coalesce(tp / nullif(tp + fp, 0), 0), 2) AS precision, round_even(100 * coalesce(tp / nullif(tp + fn, 0), 0), 2) AS recall, round_even(100 * coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 2) AS f1"""


@query(f"""
WITH {GOLD}, t AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold),
n AS (SELECT threshold, count(*) FILTER (human < threshold AND NOT ours) AS tn, count(*) FILTER (human < threshold AND ours) AS fp, count(*) FILTER (human >= threshold AND NOT ours) AS fn, count(*) FILTER (human >= threshold AND ours) AS tp FROM t LEFT JOIN j ON human IS NOT NULL GROUP BY threshold)
SELECT *, {_PRF} FROM n""")
def pr_f1_thresholds(spark, sf):
    return metrics.threshold_report(judged(spark, sf), "human", "ours", THRESHOLDS)


@query(f"""
WITH {GOLD}, r AS (SELECT human >= 0.5 AS y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM j WHERE human IS NOT NULL), c AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q, sum(k) FILTER (y) AS s FROM r)
SELECT round((s - p * (p + 1) / 2.0) / nullif(p * q, 0), 9) AS auc FROM c""")
def roc_auc(spark, sf):
    return metrics.roc_auc(judged(spark, sf).withColumn("y", F.col("human") >= 0.5), "score", "y").select(F.round("auc", 9).alias("auc"))


@query(f"WITH {GOLD} SELECT document_id, CASE WHEN human >= 0.5 AND ours THEN 'tp' WHEN ours THEN 'fp' WHEN human >= 0.5 THEN 'fn' ELSE 'tn' END AS outcome FROM j")
def cm_tag(spark, sf):
    return judged(spark, sf).select("document_id", metrics.outcome(F.col("human") >= 0.5, F.col("ours")).alias("outcome"))


@query(f"WITH {GOLD} SELECT count(*) FILTER (human < 0.5 AND NOT ours) AS tn, count(*) FILTER (human < 0.5 AND ours) AS fp, count(*) FILTER (human >= 0.5 AND NOT ours) AS fn, count(*) FILTER (human >= 0.5 AND ours) AS tp FROM j WHERE human IS NOT NULL")
def binary_counts(spark, sf):
    return metrics.binary_report(judged(spark, sf).withColumn("y", F.col("human") >= 0.5), "y", "ours").select("tn", "fp", "fn", "tp")


@query(f"WITH {GOLD}, b AS (SELECT j.document_id, list(id ORDER BY id) AS ids FROM j JOIN llm_met_scores l ON regexp_replace(l.doc_id, '^(.{{36}})-[0-9]+$', '\\1') = j.document_id WHERE human >= 0.5 AND NOT ours GROUP BY ALL) SELECT document_id, ids FROM b")
def examples_of_outcome(spark, sf):
    """The missed documents with their candidates nested."""
    missed = judged(spark, sf).where("human >= 0.5 AND NOT ours").select("document_id")
    cands = table(spark, sf, "llm_met_scores").select(ids.strip_episode_chunk(F.col("doc_id")).alias("document_id"), "id")
    return missed.join(cands, "document_id").groupBy("document_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))


RATERS = """
r AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN event_id % 3 END AS a, CASE WHEN event_id % 13 > 0 THEN (event_id + (event_id % 5 = 0)::INT) % 3 END AS b FROM events),
p AS (SELECT a, b FROM r WHERE a IS NOT NULL AND b IS NOT NULL),
v AS (SELECT v, count(*) AS n FROM (SELECT a AS v FROM p UNION ALL SELECT b FROM p) GROUP BY v)
"""


def raters(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.when(e % 11 > 0, e % 3).alias("a"), F.when(e % 13 > 0, (e + (e % 5 == 0).cast("int")) % 3).alias("b"))


@query(f"WITH {RATERS} SELECT round(1 - (sum(n) - 1) * (SELECT 2 * count(*) FROM p WHERE a <> b) / (sum(n) * sum(n) - sum(n * n)), 9) AS alpha FROM v")
def krippendorff(spark, sf):
    return metrics.krippendorff_alpha(raters(spark, sf), "a", "b").select(F.round("alpha", 9).alias("alpha"))


@query(f"WITH {RATERS}, e AS (SELECT sum(n / t * (1 - n / t)) / (count(*) - 1) AS pe FROM v, (SELECT sum(n) AS t FROM v)), o AS (SELECT avg((a = b)::INT::DOUBLE) AS pa FROM p) SELECT round((pa - pe) / (1 - pe), 9) AS ac1 FROM e, o")
def gwet_ac1(spark, sf):
    return metrics.gwet_ac1(raters(spark, sf), "a", "b").select(F.round("ac1", 9).alias("ac1"))


@query(f"WITH {RATERS} SELECT round(avg((a = b)::INT::DOUBLE), 9) AS agreement FROM p")
def pct_agreement(spark, sf):
    return metrics.percent_agreement(raters(spark, sf), "a", "b").select(F.round("agreement", 9).alias("agreement"))


@query("SELECT (sum((event_id % 3 = 0)::INT) + sum((event_id % 4 = 0)::INT)) / 2 AS agreed FROM events")
def agreement_count(spark, sf):
    rows = table(spark, sf, "events").select((F.col("event_id") % 3 == 0).alias("a"), (F.col("event_id") % 4 == 0).alias("b"))
    return metrics.agreed_share(rows, "a", "b")


@query(f"WITH {RATERS} SELECT a, b, count(*) AS n FROM r GROUP BY ALL")
def confusion_matrix(spark, sf):
    return metrics.confusion(raters(spark, sf), "a", "b")


_CLASSES = f"""
WITH {RATERS}, k AS (SELECT v AS c FROM v), t AS (SELECT c, count(*) FILTER (a = c AND b = c) AS tp, count(*) FILTER (a = c) AS support, count(*) FILTER (b = c) AS predicted FROM k, p GROUP BY c),
q AS (SELECT CAST(c AS VARCHAR) AS class, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1, support, tp FROM t)
"""


@query(_CLASSES + """
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM (
SELECT class, precision, recall, f1, support FROM q UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM q
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM q
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM q)""")
def class_report(spark, sf):
    out = metrics.class_report(raters(spark, sf), "a", "b")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(_CLASSES + "SELECT round(avg(f1), 9) AS macro_f1 FROM q")
def macro_f1(spark, sf):
    out = metrics.class_report(raters(spark, sf), "a", "b").where(F.col("class") == "macro avg")
    return out.select(F.round("f1", 9).alias("macro_f1"))


@query("""
WITH a AS (SELECT user_id % 3 AS annotator, event_id AS example_id, event_id % 3 + 1 AS answer FROM events), s AS (SELECT event_id AS example_id, (event_id // 2) % 3 + 1 AS answer, ['easy', 'medium', 'hard'][event_id % 3 + 1] AS difficulty FROM events)
SELECT annotator, difficulty, count(*) AS n, round(avg((a.answer = s.answer)::INT::DOUBLE), 9) AS accuracy FROM a JOIN s USING (example_id) GROUP BY ALL""")
def intrusion_accuracy(spark, sf):
    e = table(spark, sf, "events")
    answers = e.select((F.col("user_id") % 3).alias("annotator"), F.col("event_id").alias("example_id"), (F.col("event_id") % 3 + 1).alias("answer"))
    kinds = F.array(F.lit("easy"), F.lit("medium"), F.lit("hard"))
    solutions = e.select(F.col("event_id").alias("example_id"), (F.floor(F.col("event_id") / 2) % 3 + 1).alias("answer"), F.get(kinds, (F.col("event_id") % 3).cast("int")).alias("difficulty"))
    return metrics.intrusion_accuracy(answers, solutions, ["annotator", "difficulty"]).withColumn("accuracy", F.round("accuracy", 9))


@query("""
WITH j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 3 END AS x, CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS y FROM events)
SELECT event_id, CAST(x + y AS INTEGER) AS total FROM j""")
def rubric_scores(spark, sf):
    e = table(spark, sf, "events")
    judged_ = e.select("event_id", F.get(F.array(*[F.lit(x) for x in (" true ", "False", "UNSURE", "3")]), (F.col("event_id") % 4).cast("int")).alias("q1"), F.get(F.array(F.lit("TRUE"), F.lit("not metaphorical"), F.lit(None).cast("string")), (F.col("user_id") % 3).cast("int")).alias("q2"))
    return metrics.rubric(judged_, {"total": ["q1", "q2"]}).select("event_id", "total")


@query(f"""
WITH {GOLD}, t AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold),
n AS (SELECT threshold, count(*) FILTER (score < threshold AND human < 0.5) AS tn, count(*) FILTER (score >= threshold AND human < 0.5) AS fp, count(*) FILTER (score < threshold AND human >= 0.5) AS fn, count(*) FILTER (score >= threshold AND human >= 0.5) AS tp FROM t LEFT JOIN j ON human IS NOT NULL GROUP BY threshold)
SELECT *, {_PRF} FROM n""")
def pr_f1_own_thresholds(spark, sf):
    """Thresholds of our score against the human class."""
    return metrics.threshold_report(judged(spark, sf).withColumn("y", F.col("human") >= 0.5), "score", "y", THRESHOLDS, predicted=True)


@query(f"""
WITH {GOLD}, t AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold), r AS (SELECT human, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM j WHERE human IS NOT NULL),
c AS (SELECT threshold, count(*) FILTER (human >= threshold) AS p, count(*) FILTER (human < threshold) AS q, sum(k) FILTER (human >= threshold) AS s FROM t, r GROUP BY threshold)
SELECT threshold, round((s - p * (p + 1) / 2.0) / nullif(p * q, 0), 9) AS auc FROM c""")
def roc_auc_thresholds(spark, sf):
    return metrics.roc_auc_thresholds(judged(spark, sf), "score", "human", THRESHOLDS).select("threshold", F.round("auc", 9).alias("auc"))


@query(_CLASSES + """
SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, round(sum(tp) / sum(support), 9) AS micro_f1, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall FROM q""")
def overall_scores(spark, sf):
    out = metrics.overall_scores(raters(spark, sf), "a", "b")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("""
WITH j AS (SELECT CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 3 END AS x, CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS y FROM events)
SELECT round(avg(x + y), 9) AS total, round(avg((x = 1)::INT::DOUBLE), 9) AS "q1?", round(avg(coalesce((y = 1)::INT::DOUBLE, 0)), 9) AS "q2?" FROM j""")
def rubric_means(spark, sf):
    e = table(spark, sf, "events")
    sheet = e.select(F.get(F.array(*[F.lit(x) for x in (" true ", "False", "UNSURE", "3")]), (F.col("event_id") % 4).cast("int")).alias("q1?"), F.get(F.array(F.lit("TRUE"), F.lit("not metaphorical"), F.lit(None).cast("string")), (F.col("user_id") % 3).cast("int")).alias("q2?"))
    out = metrics.rubric_means(sheet, {"total": ["q1?", "q2?"]})
    return out.select(*[F.round(F.col(f"`{c}`"), 9).alias(c) for c in out.columns])
