"""Queries over the project's tables, named pN_ for problem N; ``oracle_sql`` has those that SQL can state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import checkpointed, table, tidy
from .birch import cluster_members, cluster_report, label_of
from .cutoff import cutoffs
from .mix import Mixture
from .pack import pack, pack_report
from .similar import most_similar, most_similar_to
from .spans import fuzzy_passages, shared_lengths, shared_spans
from .split import distinct_pieces, split_texts
from .tokens import token_counts
from .top_n import latest, top_n_per_group

DIM = 64
FEATURES = ("noun_classification", "target_group", "source_image_schema_group")
CAPACITY = 512


def source_document(doc_id: Column) -> Column:
    """A document's id without outer blanks, case and chunk suffix, which only the 36 characters of an episode have."""
    return F.regexp_replace(tidy(doc_id), r"^(.{36})-\d+$", "$1")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "met_embeddings")
    return cluster_members(rows, "idx", "emb", [label_of(F.col(f"features.{f}")) for f in FEATURES], DIM)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).where("idx <> first").select(F.col("first").alias("first_idx"), "idx")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(checkpointed(_clusters(spark, sf_dir)), "idx", 5)


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(table(spark, sf_dir, "clust_export"), "met_id", "exported_at", ["cluster", "distance"])
    return top_n_per_group(rows.where("distance >= 0 AND NOT isnan(distance) AND cluster >= 0"), "cluster", "distance", "met_id", 10)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("cluster", "met_id")


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).withColumnRenamed("rank", "nearest_rank")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = most_similar(table(spark, sf_dir, "met_embeddings"), "idx", "emb", DIM, k=5, min_similarity=0.95)
    pairs = near.select(F.least("idx", "other").cast("int").alias("idx_a"), F.greatest("idx", "other").cast("int").alias("idx_b"))
    return pairs.distinct()


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar of all records for every record whose idx is divisible by 20."""
    return most_similar_to(table(spark, sf_dir, "met_embeddings"), "idx", "emb", DIM, lambda i: i % 20 == 0, k=5)


def _pieces(spark: SparkSession, sf_dir: str, placement: str) -> DataFrame:
    return distinct_pieces(split_texts(table(spark, sf_dir, "doc_store"), "id", "text", 5000, 250, placement, with_text=False), "id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "full")


def p4_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "balanced")


def p4_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text's balanced pieces: where they end, and whether they keep the limit, cover the text and overlap."""
    before = F.lag("end_char").over(Window.partitionBy("id").orderBy("piece_no"))
    rows = _pieces(spark, sf_dir, "balanced").withColumn("before", before)
    return rows.groupBy("id").agg(
        F.max("end_char").cast("long").alias("n_chars"), (F.max(F.col("end_char") - F.col("start_char")) <= 5000).alias("within"),
        (F.min("start_char") == 0).alias("whole"), (F.min(F.col("before") - F.col("start_char")).between(1, 250) & (F.max(F.col("before") - F.col("start_char")) <= 250)).alias("overlapping"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = latest(table(spark, sf_dir, "llm_met_scores"), "id", "scored_at", ["doc_id", "dataset", "llm_met_score"])
    rows = rows.where("llm_met_score BETWEEN 0 AND 1").select("id", source_document(F.col("doc_id")).alias("source"), "dataset", F.col("llm_met_score").alias("score"))
    rows = checkpointed(rows.join(table(spark, sf_dir, "keep_targets"), "dataset"))
    return rows, cutoffs(rows, "source", "score", "keep_pct")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cut = _scored(spark, sf_dir)
    return rows.join(cut.select("source", "cutoff"), "source").where("score >= cutoff").select("id")


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[1].select("source", "cutoff", "n_rows", "n_kept")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).groupBy("doc_id").agg(F.count("*").cast("int").alias("min_pieces")).where("min_pieces > 1")


def p6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its tokens in the bins, its pieces, and whether they follow each other without a gap."""
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("doc_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = _packed(spark, sf_dir).withColumn("joined", F.col("start_token") == before)
    return rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"), F.min("joined").alias("joined"))


def p6_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens in the bins, and whether each bin keeps its limits of tokens and pieces."""
    bins = _packed(spark, sf_dir).groupBy("bin").agg(F.sum("n_tokens").alias("load"), F.count("*").alias("n"))
    return bins.agg(F.sum("load").alias("n_tokens"), F.coalesce(F.max("load") <= CAPACITY, F.lit(True)).alias("tokens_kept"), F.coalesce(F.max("n") <= 64, F.lit(True)).alias("pieces_kept"))


def p6_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_report(_packed(spark, sf_dir), CAPACITY)


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[Mixture, list[str]]:
    """The mixture, and the targets' sources as they are written in the table."""
    counts = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", keep=["source"])
    labelled = counts.select("doc_id", "n_tokens", F.array(tidy(F.col("source"))).alias("sources"))
    targets = table(spark, sf_dir, "mix_targets").where("source IS NOT NULL").select(tidy(F.col("source")).alias("label"), "weight_pct", "max_passes", "source").take(10_001)
    return Mixture(labelled, "doc_id", [tuple(r)[:3] for r in targets]), [r["source"] for r in targets]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix, written = _mixture(spark, sf_dir)
    shares = [(name, n, reached) for name, (_, n, reached, _) in zip(written, mix.shares())]
    return spark.createDataFrame(shares, "source STRING, n_passes INT, reached INT")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0].selection()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = _mixture(spark, sf_dir)[0]
    got = mix.selection().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("n_tokens"))
    weights = spark.createDataFrame([(s, float(w)) for s, w, _ in mix.targets], "source STRING, target_pct DOUBLE")
    total = got.agg(F.sum("n_tokens").alias("all"))
    n = F.coalesce("n_tokens", F.lit(0))
    return weights.join(got, "source", "left").crossJoin(F.broadcast(total)).select("source", "target_pct", n.alias("n_tokens"), F.round(100 * n / F.col("all"), 6).alias("actual_pct"))


def p7_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture in which a document counts for its outlet and for its language: the outlets take 80 percent by their weights, English 15, Spanish 5."""
    counts = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", keep=["source", "lang"])
    labels = F.array_compact(F.array(tidy(F.col("source")), F.concat(F.lit("language "), tidy(F.col("lang")))))
    outlets = table(spark, sf_dir, "mix_targets").where("source IS NOT NULL").select(tidy(F.col("source")).alias("label"), "weight_pct", "max_passes").take(10_001)
    targets = [(r["label"], r["weight_pct"] * 0.8, r["max_passes"]) for r in outlets] + [("language en", 15, 3), ("language es", 5, 3)]
    mix = Mixture(counts.select("doc_id", "n_tokens", labels.alias("sources")), "doc_id", targets)
    return spark.createDataFrame(mix.shares(), "source STRING, n_passes INT, reached INT, n_tokens LONG")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_lengths(shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text", 160), "doc_id")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages(table(spark, sf_dir, "documents"), "doc_id", "text", 160)


def queries() -> dict:
    names = "p1_found p1_clusters p2_found p2_nearest p3_found p3_nearest p4_found p4_balanced p4_limits p5_found p5_cutoffs p6_found p6_sequences p6_pieces p6_limits p6_used p7_found p7_mixture p7_shares p7_overlap p8_found p8_passages"
    return {n: globals()[n] for n in names.split()}


_NEAREST = """
WITH last AS (SELECT met_id, cluster, distance FROM clust_export WHERE met_id IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY met_id ORDER BY exported_at DESC NULLS LAST) = 1)
SELECT cluster, met_id, distance, CAST(row_number() OVER (PARTITION BY cluster ORDER BY distance, met_id) AS INTEGER) AS nearest_rank
FROM last WHERE distance >= 0 AND NOT isnan(distance) AND cluster >= 0
QUALIFY nearest_rank <= 10
"""

_USABLE = """
usable AS (SELECT idx, list_transform(any_value(emb), lambda v: v::DOUBLE) AS emb FROM met_embeddings WHERE idx IS NOT NULL AND len(emb) = 64
           AND len(list_filter(emb, lambda v: isfinite(v))) = 64 AND len(list_filter(emb, lambda v: v <> 0)) > 0 GROUP BY idx)
"""

_CUTOFFS = r"""
last AS (SELECT id, dataset, llm_met_score AS score, regexp_replace(lower(trim(doc_id, E' \t\n\r')), '^(.{36})-[0-9]+$', '\1') AS source
         FROM llm_met_scores WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY scored_at DESC NULLS LAST) = 1),
rated AS (SELECT id, source, score, keep_pct FROM last JOIN keep_targets USING (dataset) WHERE score BETWEEN 0 AND 1 AND source IS NOT NULL),
ranked AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, count(*) OVER (PARTITION BY source ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS above FROM rated),
cut AS (SELECT source, max(score) AS cutoff, any_value(n) AS n_rows, min(above) AS n_kept FROM ranked WHERE 100 * above >= keep_pct * n GROUP BY source)
"""

_TOKENS = r"""
counted AS (SELECT doc_id, source, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+')) AS n FROM documents WHERE text IS NOT NULL)
"""

_MIXED = r"""
named AS (SELECT lower(trim(source, E' \t\n\r')) AS source, weight_pct, max_passes FROM mix_targets WHERE source IS NOT NULL),
docs AS (SELECT doc_id, CAST(n AS INTEGER) AS n_tokens, lower(trim(c.source, E' \t\n\r')) AS source FROM counted c WHERE n > 0 AND lower(trim(c.source, E' \t\n\r')) IN (SELECT source FROM named)),
size AS (SELECT source, CAST(sum(n_tokens) AS HUGEINT) AS s FROM docs GROUP BY source),
flow AS (SELECT source, s, least(weight_pct * (SELECT sum(s) FROM size), 100 * max_passes * s) AS f FROM named JOIN size USING (source)),
placed AS (SELECT doc_id, n_tokens, source, f // (100 * s) AS whole, (f % (100 * s) + 99) // 100 AS rest,
           coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs JOIN flow USING (source)),
mixed AS (SELECT source, doc_id, n_tokens, CAST(whole + CASE WHEN before < rest THEN 1 ELSE 0 END AS INTEGER) AS n_copies FROM placed)
"""

# the piece from place s: whether more than 5000 characters are left, else where the strongest kind's last boundary lies
_PIECES = r"""
store AS (SELECT id, any_value(text) AS text, length(any_value(text)) AS n FROM doc_store WHERE length(text) > 5000 GROUP BY id, md5(text)),
piece AS (
  SELECT id, text, n, 1 AS no, 0 AS s, 0 AS e, false AS done FROM store
  UNION ALL
  SELECT id, text, n, no + 1, CASE WHEN last THEN s ELSE stop - 251 + CASE WHEN back = 0 THEN 1 ELSE back END END, CASE WHEN last THEN n ELSE stop END, last
  FROM (SELECT *, length(regexp_extract(substr(text, stop - 250, 251), '(?s)^(.*?[ \t\n\r])[^ \t\n\r]', 1)) AS back FROM (
    SELECT *, n - s <= 5000 AS last, s + CASE WHEN a > 250 THEN a WHEN b > 250 THEN b WHEN c > 250 THEN c ELSE 5000 END AS stop FROM (
      SELECT *, length(regexp_extract(w, '(?s)^(.*[.!?][ \t\n\r]+)', 1)) AS a, length(regexp_extract(w, '(?s)^(.*[,;:-][ \t\n\r]+)', 1)) AS b, length(regexp_extract(w, '(?s)^(.* )', 1)) AS c
      FROM (SELECT *, substr(text, s + 1, 5000) AS w FROM piece WHERE NOT done))))
)
"""

_SPANS = """
w AS (SELECT doc_id, i, hash(substr(text, CAST(i AS BIGINT) + 1, 160)) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - 159)) AS i FROM documents WHERE length(text) >= 160)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
o AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM w SEMI JOIN s USING (h))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"SELECT cluster, met_id FROM ({_NEAREST})",
        "p2_nearest": _NEAREST,
        "p3_found": f"""
WITH {_USABLE},
sims AS (SELECT a.idx AS a, b.idx AS b, round(list_cosine_similarity(a.emb, b.emb), 9) AS s FROM usable a JOIN usable b ON a.idx <> b.idx),
best AS (SELECT a, b, s FROM sims WHERE s >= 0.95 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS idx_a, greatest(a, b) AS idx_b FROM best""",
        "p4_found": f"""
WITH RECURSIVE {_PIECES}, starts AS (SELECT id, no, s, lead(e) OVER (PARTITION BY id, md5(text) ORDER BY no) AS e FROM piece)
SELECT DISTINCT id, CAST(no AS INTEGER) AS piece_no, CAST(s AS INTEGER) AS start_char, CAST(e AS INTEGER) AS end_char FROM starts WHERE e IS NOT NULL""",
        "p4_limits": "SELECT DISTINCT id, length(text) AS n_chars, true AS within, true AS whole, true AS overlapping FROM doc_store WHERE length(text) > 5000",
        "p5_found": f"WITH {_CUTOFFS} SELECT id FROM rated JOIN cut USING (source) WHERE score >= cutoff",
        "p5_cutoffs": f"WITH {_CUTOFFS} SELECT source, cutoff, n_rows, n_kept FROM cut",
        "p6_found": f"WITH {_TOKENS} SELECT doc_id, CAST(ceil(n / 512.0) AS INTEGER) AS min_pieces FROM counted WHERE n > 512",
        "p6_pieces": f"WITH {_TOKENS} SELECT doc_id, n AS n_tokens, CAST(ceil(n / 512.0) AS BIGINT) AS n_pieces, true AS joined FROM counted WHERE n > 0",
        "p6_limits": f"WITH {_TOKENS} SELECT CAST(sum(n) AS BIGINT) AS n_tokens, true AS tokens_kept, true AS pieces_kept FROM counted",
        "p7_mixture": f"WITH {_TOKENS}, {_MIXED} SELECT * FROM mixed WHERE n_copies > 0",
        "p7_shares": f"""
WITH {_TOKENS}, {_MIXED}, got AS (SELECT source, CAST(sum(n_tokens * n_copies) AS BIGINT) AS t FROM mixed GROUP BY source)
SELECT source, CAST(weight_pct AS DOUBLE) AS target_pct, coalesce(t, 0) AS n_tokens, round(100 * coalesce(t, 0) / (SELECT sum(t) FROM got), 6) AS actual_pct FROM named LEFT JOIN got USING (source)""",
        "p7_found": f"""
WITH {_TOKENS},
mine AS (SELECT t.source, weight_pct, max_passes, coalesce((SELECT sum(n) FROM counted c WHERE lower(trim(c.source, E' \\t\\n\\r')) = lower(trim(t.source, E' \\t\\n\\r'))), 0) AS s FROM mix_targets t),
whole AS (SELECT sum(s) AS t FROM mine)
SELECT source, CAST(CASE WHEN s = 0 THEN 0 ELSE least(max_passes, ceil(weight_pct * t / 100.0 / s)) END AS INTEGER) AS n_passes,
       CAST(CASE WHEN 100 * max_passes * s >= weight_pct * t THEN 1 ELSE 0 END AS INTEGER) AS reached FROM mine, whole""",
        "p8_found": f"WITH {_SPANS} SELECT doc_id, CAST(sum(least(160, coalesce(nxt - i, 160))) AS INTEGER) AS shared_chars FROM o GROUP BY doc_id",
    }
