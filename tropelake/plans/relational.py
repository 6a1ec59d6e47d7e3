"""Joins, restrictions, reshaping, sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import aggregates, features, ranking, relational, sampling
from .registry import query, table


def tidy(c):
    return F.lower(F.btrim(F.col(c), F.lit(" \t\n\r")))


TIDY = "lower(trim({}, E' \\t\\n\\r'))"


@query("SELECT c_custkey, coalesce(o.n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) o ON c_custkey = o_custkey")
def left_join_default(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return relational.enrich(table(spark, sf, "customer").select("c_custkey"), counts, ["c_custkey"], {"n_orders": 0})


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM documents WHERE polarity = 'left')")
def semi_processed(spark, sf):
    docs = table(spark, sf, "documents")
    return relational.only(docs.select("doc_id", "text"), docs.where("polarity = 'left'").select("doc_id"), ["doc_id"])


@query("SELECT DISTINCT id FROM doc_store WHERE id NOT IN (SELECT document_id FROM doc_annotations WHERE document_id IS NOT NULL)")
def anti_resume(spark, sf):
    done = table(spark, sf, "doc_annotations").select(F.col("document_id").alias("id"))
    return relational.remaining(table(spark, sf, "doc_store").select("id").distinct(), done, ["id"])


@query("SELECT DISTINCT d.id, d.num_sentences FROM doc_store d WHERE EXISTS (SELECT 1 FROM doc_annotations a WHERE a.document_id = d.id AND a.annotation_type = 'human_metaphor_score')")
def hand_labelled(spark, sf):
    labelled = table(spark, sf, "doc_annotations").where("annotation_type = 'human_metaphor_score'").select(F.col("document_id").alias("id"))
    return relational.only(table(spark, sf, "doc_store").select("id", "num_sentences"), labelled, ["id"]).distinct()


@query(f"""
SELECT document_id, min(v) FILTER (t = 'polarity') AS polarity, min(v) FILTER (t = 'human_metaphor_score') AS human_metaphor_score, min(v) FILTER (t = 'human_source_domain') AS human_source_domain
FROM (SELECT {TIDY.format('document_id')} AS document_id, annotation_type AS t, {TIDY.format('annotation_value')} AS v FROM doc_annotations) GROUP BY document_id""")
def eav_pivot(spark, sf):
    rows = table(spark, sf, "doc_annotations").select(tidy("document_id").alias("document_id"), "annotation_type", tidy("annotation_value").alias("annotation_value"))
    return relational.attributes_wide(rows, "document_id", "annotation_type", "annotation_value", ["polarity", "human_metaphor_score", "human_source_domain"])


@query(r"""
WITH f AS (SELECT met_id, cluster, distance, target_group, target_ppto, source_image_schema_group, entailment_text FROM clust_export QUALIFY row_number() OVER (PARTITION BY met_id ORDER BY exported_at DESC) = 1),
e AS (SELECT episode, min(channel) AS channel, min(polarity) AS polarity FROM episodes GROUP BY episode),
m AS (SELECT id, min(sentence) AS sentence, min(source_word) AS source_word, min(target_word) AS target_word FROM llm_met_scores GROUP BY id),
t AS (SELECT id, min(idx) AS idx FROM met_embeddings WHERE id IS NOT NULL GROUP BY id),
r AS (SELECT cluster, CAST(row_number() OVER (ORDER BY count(*) DESC, cluster) AS INTEGER) AS clust_imp_rank FROM f WHERE cluster IS NOT NULL GROUP BY cluster)
SELECT f.met_id, f.distance, f.cluster, r.clust_imp_rank, f.target_ppto AS noun_classification, f.target_group, f.source_image_schema_group, m.source_word, m.target_word, m.sentence, f.entailment_text, e.channel, e.polarity
FROM f JOIN t ON t.id = f.met_id LEFT JOIN m ON m.id = f.met_id LEFT JOIN r ON r.cluster = f.cluster LEFT JOIN e ON e.episode = string_split(f.met_id, '_')[1]""")
def star_export(spark, sf):
    """The export of embedded metaphors: every table looked up by its key.  The rank is by size; documents are whole episodes.

    A metaphor is known by its id throughout, as an ``idx`` of the embeddings may be null or stand for several.
    """
    facts = relational.keep_first(table(spark, sf, "clust_export"), ["met_id"], [F.desc("exported_at")]).withColumnRenamed("met_id", "id")
    placed = relational.only(facts, table(spark, sf, "met_embeddings").select("id"), ["id"]).withColumn("idx", F.col("id"))
    classes = table(spark, sf, "llm_met_scores").groupBy("id").agg(*[F.min(c).alias(c) for c in ("source_word", "target_word", "sentence")])
    docs = table(spark, sf, "episodes").groupBy(F.col("episode").alias("doc_id")).agg(F.min("channel").alias("channel"), F.min("polarity").alias("polarity"))
    sizes = facts.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"))
    importance = sizes.select("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")).alias("importance_rank"))  # a row per cluster
    named = facts.select("id", F.struct(F.col("target_ppto").alias("noun_classification"), "target_group", "source_image_schema_group").alias("features"))
    return features.cluster_export(placed.select("idx", F.col("cluster").alias("label")), placed.select("idx", "id", F.lit("").alias("text")), named, classes, facts.select("id", "entailment_text"), docs, importance, placed.select("idx", "distance"))


@query("""
WITH s AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) - 1 AS b FROM lineitem GROUP BY l_orderkey)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l JOIN s ON s.l_orderkey = l.l_orderkey AND l.l_linenumber BETWEEN s.a AND s.b""")
def interval_containment(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    spans = lines.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), (F.max("l_linenumber") - 1).alias("b"))
    return relational.containing(lines, spans, ["l_orderkey"], "l_linenumber", "a", "b").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
WITH s AS (SELECT user_id, event_type, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY ALL)
SELECT x.user_id, x.event_type AS type_a, y.event_type AS type_b FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_type < y.event_type AND x.a < y.b AND x.b > y.a""")
def interval_overlap(spark, sf):
    events = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = events.groupBy("user_id", "event_type").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    other = spans.select("user_id", F.col("event_type").alias("type_b"), F.col("a").alias("c"), F.col("b").alias("d"))
    met = relational.overlapping(spans, other, ["user_id"], ("a", "b"), ("c", "d"))
    return met.where("event_type < type_b").select("user_id", F.col("event_type").alias("type_a"), "type_b")


@query("""
WITH s AS (SELECT c_custkey AS k, CAST(floor(c_acctbal) AS BIGINT) AS a, CAST(floor(c_acctbal) AS BIGINT) + 15 AS b FROM customer),
t AS (SELECT s_suppkey AS j, CAST(floor(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) + 15 AS d FROM supplier)
SELECT k, j FROM s JOIN t ON a < d AND b > c""")
def interval_overlap_spread(spark, sf):
    """Overlap without an equal key, by cells."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.floor("c_acctbal").alias("a")).withColumn("b", F.col("a") + 15)
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("j"), F.floor("s_acctbal").alias("c")).withColumn("d", F.col("c") + 15)
    return relational.overlapping_spread(a, b, ("a", "b"), ("c", "d"), 15).select("k", "j")


@query("SELECT met_id, cluster, exported_at FROM clust_export QUALIFY row_number() OVER (PARTITION BY met_id ORDER BY exported_at) = 1")
def keep_first(spark, sf):
    return relational.keep_first(table(spark, sf, "clust_export").select("met_id", "cluster", "exported_at"), ["met_id"], ["exported_at"])


@query("SELECT k, max_by(v, p) AS v FROM (SELECT n_nationkey AS k, n_name AS v, 0 AS p FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region) GROUP BY k")
def overlay_last_wins(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    b = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))
    return relational.overlay([a, b], ["k"])


@query("""
WITH g AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p, list(l_quantity ORDER BY l_linenumber, l_partkey) AS q FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, unnest(p) AS p, unnest(q) AS q FROM g""")
def zipped_explode(spark, sf):
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    return relational.unzip(lists.select("l_orderkey", F.col("x.l_partkey").alias("p"), F.col("x.l_quantity").alias("q")), "p", "q")


@query("SELECT r_regionkey, name, value FROM (SELECT r_regionkey, 'n_nations' AS name, count(*) AS value FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL UNION ALL SELECT r_regionkey, 'max_key', max(n_nationkey) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)")
def unpivot_report(spark, sf):
    wide = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n_nations"), F.max("n_nationkey").alias("max_key"))
    return relational.long_form(wide, ["r_regionkey"], ["n_nations", "max_key"])


@query("""
WITH p AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS i, greatest(l_partkey, l_suppkey) AS j FROM lineitem WHERE l_partkey <> l_suppkey),
b AS (SELECT i AS node, j AS n FROM p UNION ALL SELECT j, i FROM p)
SELECT node, list_sort(list_distinct(list(n))) AS neighbours FROM b GROUP BY node""")
def adjacency_sets(spark, sf):
    pairs = table(spark, sf, "lineitem").where("l_partkey <> l_suppkey").select(F.least("l_partkey", "l_suppkey").alias("i"), F.greatest("l_partkey", "l_suppkey").alias("j")).distinct()
    return relational.adjacency(pairs, "i", "j")


@query("""
WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(orders, []) AS orders FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def nested_lists(spark, sf):
    rows = relational.nested(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "c_custkey", "o_custkey", ["o_orderkey"], "orders")
    return rows.select("c_custkey", F.transform("orders", lambda x: x["o_orderkey"]).alias("orders"))


@query("SELECT * FROM (SELECT id, dataset, llm_met_score FROM llm_met_scores WHERE llm_met_score >= 0.4 AND NOT isnan(llm_met_score))")
def threshold_filter(spark, sf):
    return table(spark, sf, "llm_met_scores").where("llm_met_score >= 0.4 AND NOT isnan(llm_met_score)").select("id", "dataset", "llm_met_score")


@query(r"""
SELECT id, lower(trim(source_word)) AS source_word, lower(trim(target_word)) AS target_word, coalesce(llm_met_score > 0.5 AND NOT isnan(llm_met_score), false) AS llm_met_class FROM llm_met_scores WHERE lower(target_word) NOT IN ('you', 'i', 'it', 'this', 'that')""")
def llm_class_frame(spark, sf):
    rows = table(spark, sf, "llm_met_scores").where(~F.lower("target_word").isin("you", "i", "it", "this", "that"))
    met = F.coalesce((F.col("llm_met_score") > 0.5) & ~F.isnan("llm_met_score"), F.lit(False))
    return rows.select("id", F.lower(F.trim("source_word")).alias("source_word"), F.lower(F.trim("target_word")).alias("target_word"), met.alias("llm_met_class"))


# --- samples

LOT = "md5(CAST({} AS VARCHAR) || '|42')"


@query(f"SELECT doc_id FROM documents ORDER BY {LOT.format('doc_id')}, doc_id LIMIT 100")
def hash_sample(spark, sf):
    return sampling.draw(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


@query(f"SELECT DISTINCT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {LOT.format('doc_id')}, doc_id) <= 5")
def group_sample(spark, sf):
    return sampling.draw_each(table(spark, sf, "documents").select("source", "doc_id"), ["source"], "doc_id", 5)


@query(f"""
WITH n AS (SELECT source FROM documents GROUP BY source HAVING count(*) >= 20)
SELECT source, doc_id FROM documents SEMI JOIN n USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY coalesce(lang, '') <> 'en', {LOT.format('doc_id')}, doc_id) <= 20""")
def preferred_first_sample(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", "lang")
    prefer = (F.coalesce("lang", F.lit("")) != "en").cast("int")
    return sampling.draw_each(rows, ["source"], "doc_id", 20, prefer=prefer, full_only=True).select("source", "doc_id")


_SCORED = "scored AS (SELECT id, llm_met_score AS score FROM llm_met_scores WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY scored_at DESC, llm_met_score DESC) = 1), rated AS (SELECT * FROM scored WHERE score BETWEEN 0 AND 1)"


def _rated(spark, sf):
    rows = relational.keep_first(table(spark, sf, "llm_met_scores").where("id IS NOT NULL"), ["id"], [F.desc("scored_at"), F.desc("llm_met_score")])
    return rows.where("llm_met_score BETWEEN 0 AND 1").select("id", F.col("llm_met_score").alias("score"))


@query(f"""
WITH {_SCORED}, c AS (SELECT id, round(score, 1) AS s, {LOT.format('id')} AS lot, row_number() OVER (PARTITION BY round(score, 1) ORDER BY {LOT.format('id')}, id) AS n FROM rated)
SELECT id, s FROM c ORDER BY n > 50, lot, id LIMIT 550""")
def stratified_sample(spark, sf):
    return sampling.draw_stratified(_rated(spark, sf).select("id", F.round("score", 1).alias("s")), "s", "id", 550, 11)


@query(f"""
WITH {_SCORED}, c AS (SELECT id, score, score >= 0.4 AS met, {LOT.format('id')} AS lot, row_number() OVER (PARTITION BY score >= 0.4, round(score, 1) ORDER BY {LOT.format('id')}, id) AS n FROM rated),
k AS (SELECT score >= 0.4 AS met, count(DISTINCT round(score, 1)) AS k FROM rated GROUP BY ALL),
o AS (SELECT id, score, met, lot, n > CASE WHEN met THEN 180 ELSE 20 END // k AS o FROM c JOIN k USING (met))
SELECT id, score FROM o WHERE met OR NOT o ORDER BY o, lot, id LIMIT 200""")
def quota_sample(spark, sf):
    """200 candidates to annotate, nine tenths of them metaphors, spread over scores."""
    return sampling.draw_quota(_rated(spark, sf), "id", "score", 200, 0.4)


@query(f"SELECT doc_id, CAST(row_number() OVER (ORDER BY {LOT.format('source')}, source, doc_id) AS INTEGER) AS place FROM documents WHERE source IS NOT NULL")
def doc_shuffle(spark, sf):
    rows = table(spark, sf, "documents").where("source IS NOT NULL").select("source", "doc_id")
    return sampling.shuffled_places(rows, "source", ["doc_id"]).select("doc_id", F.col("place").cast("int").alias("place"))


BUCKET = "CAST(CAST('0x' || substr(" + LOT + ", 1, 8) AS BIGINT) % {} AS INTEGER)"


@query(f"SELECT doc_id, {BUCKET.format('doc_id', 5)} AS fold FROM documents")
def kfold_buckets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sampling.bucket("doc_id", 5).alias("fold"))


@query(f"SELECT doc_id, CASE WHEN b < 70 THEN 'train' WHEN b < 80 THEN 'validation' WHEN b < 100 THEN 'test' END AS split FROM (SELECT doc_id, {BUCKET.format('doc_id', 100)} AS b FROM documents)")
def three_way_split(spark, sf):
    return sampling.split(table(spark, sf, "documents").select("doc_id"), "doc_id", {"train": 70, "validation": 10, "test": 20})


@query(f"SELECT event_id, CASE WHEN event_type = 'click' THEN 'test' WHEN {BUCKET.format('event_id', 100)} < 10 THEN 'validation' ELSE 'train' END AS split FROM events")
def group_holdout(spark, sf):
    return sampling.holdout(table(spark, sf, "events"), "event_type", "click", "event_id").select("event_id", "split")


@query(f"SELECT event_id, ['error', 'click', 'view'][{BUCKET.format('event_id', 3)} + 1] AS prediction FROM events")
def random_baseline(spark, sf):
    return sampling.random_labels(table(spark, sf, "events").select("event_id"), "event_id", ["error", "click", "view"])


@query("""
WITH f AS (SELECT source_word, id, sentence, target_word FROM (SELECT DISTINCT id, source_word, sentence, target_word FROM llm_met_scores) QUALIFY row_number() OVER (PARTITION BY source_word ORDER BY id, sentence, target_word) <= 3)
SELECT source_word, CAST(count(*) AS INTEGER) AS n, string_agg(id || ': ' || sentence, ' | ' ORDER BY id, sentence, target_word) AS examples FROM f GROUP BY source_word""")
def verb_first_examples(spark, sf):
    rows = features.verb_examples(table(spark, sf, "llm_met_scores").select("id", "source_word", "sentence", "target_word").distinct())
    lines = F.transform("examples", lambda e: F.concat(e["id"], F.lit(": "), e["sentence"]))
    return rows.select("source_word", F.size("examples").alias("n"), F.array_join(lines, " | ").alias("examples"))


@query("SELECT conv, event_id, CAST(n AS INTEGER) AS n FROM (SELECT user_id AS conv, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)")
def running_number(spark, sf):
    return ranking.running_number(table(spark, sf, "events").withColumnRenamed("user_id", "conv"), ["conv"], ["ts", "event_id"], "n").select("conv", "event_id", "n")


@query("SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY event_type")
def quartiles(spark, sf):
    return aggregates.quartiles(table(spark, sf, "events"), ["event_type"], "value")


# --- frames of the evaluation


@query("""
WITH h AS (SELECT string_split(met_id, '_')[1] AS doc, upper(min(source_word)) AS s, min(target_word) AS t FROM clust_export GROUP BY ALL)
SELECT DISTINCT m.id FROM (SELECT id, string_split(id, '_')[1] AS doc, source_word, target_word FROM llm_met_scores) m JOIN h ON h.doc = m.doc AND lower(trim(m.source_word)) = lower(trim(h.s)) AND lower(trim(m.target_word)) = lower(trim(h.t))""")
def annotated_pairs(spark, sf):
    """Candidates whose words are those annotated for their document (here the first ones of its export)."""
    doc = lambda c: ids.document(F.col(c)).alias("doc")
    human = table(spark, sf, "clust_export").groupBy(doc("met_id")).agg(F.upper(F.min("source_word")).alias("s"), F.min("target_word").alias("t"))
    pairs = table(spark, sf, "llm_met_scores").select("id", doc("id"), "source_word", "target_word")
    return relational.agreeing_pairs(pairs, human, "doc", {"source_word": "s", "target_word": "t"}).select("id").distinct()


@query("""
WITH s AS (SELECT id, CAST(floor(5 * try_cast(annotation_value AS DOUBLE)) AS INTEGER) - 1 AS score FROM doc_annotations WHERE annotation_type = 'human_metaphor_score')
SELECT id, CASE WHEN score > 1 THEN 1 ELSE 0 END AS score FROM s WHERE score IS NOT NULL AND score <> -1""")
def judged_binary(spark, sf):
    """Scores from -1, unknown, to 4 as two classes."""
    rows = table(spark, sf, "doc_annotations").where("annotation_type = 'human_metaphor_score'")
    rows = rows.select("id", (F.floor(5 * F.col("annotation_value").try_cast("double")) - 1).cast("int").alias("score"))
    return relational.judged_only(rows, "score", binary=True)


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer) ON c_custkey = o_custkey")
def checked_lookup(spark, sf):
    """A lookup that raises where the two sides' keys differ."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("k"))
    joined = relational.enrich(orders, table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("c"), "c_mktsegment"), ["k"])
    return relational.require_equal(joined, [("o_custkey", "c")]).select("o_orderkey", "o_custkey", "c_mktsegment")


@query("""
WITH a AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT user_id, event_type, a.n AS n_x, a.total AS total_x, b.n AS n_y, b.total AS total_y FROM a JOIN b USING (user_id, event_type)""")
def suffix_join(spark, sf):
    """Two raters' sheets side by side: of even and of odd events."""
    sheet = lambda k: table(spark, sf, "events").where(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return relational.suffix_join(sheet(0), sheet(1), ["user_id", "event_type"])


@query("""
WITH f AS (SELECT met_id, target_ppto, target_group FROM clust_export QUALIFY row_number() OVER (PARTITION BY met_id ORDER BY exported_at DESC) = 1)
SELECT met_id, target_ppto, CASE WHEN target_ppto IN ('person', 'place', 'thing') THEN target_group END AS target_group FROM f""")
def lookup_by_kind(spark, sf):
    """The target group from the table of the row's noun type; organizations have none."""
    facts = relational.keep_first(table(spark, sf, "clust_export"), ["met_id"], [F.desc("exported_at")]).select("met_id", "target_ppto", "target_group")
    tables = {k: facts.where(F.col("target_ppto") == k) for k in ("person", "place", "thing")}
    return relational.lookup_by_kind(facts.drop("target_group"), "target_ppto", "met_id", tables, ["target_group"]).select("met_id", "target_ppto", "target_group")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'Page view' ELSE event_type END AS event_type FROM events")
def relabelled(spark, sf):
    return relational.relabel(table(spark, sf, "events").select("event_id", "event_type"), "event_type", {"click": "Click", "view": "Page view"})


@query("SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer ORDER BY c_custkey LIMIT 100")
def numeric_order(spark, sf):
    """The first hundred keys, as numbers though they are texts."""
    return relational.numeric_order(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key")), "key").limit(100)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")
def first_documents(spark, sf):
    return relational.first_rows(table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"], 50)


@query("WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) SELECT c_custkey, s_suppkey FROM a LEFT JOIN b USING (n)")
def attached_columns(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("o"), "s_suppkey")
    return relational.attach_by_position(table(spark, sf, "customer").select("c_custkey"), "c_custkey", suppliers, "o", ["s_suppkey"])
