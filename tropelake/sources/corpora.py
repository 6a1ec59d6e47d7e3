"""Raw corpora as DataFrames with declared schemas."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.relational import keep_first, only
from ..schemas import DATASETS

EPISODES = "MAP<STRING, STRUCT<file_path: STRING, episode_date: STRING, duration: DOUBLE>>"


def subframes(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Articles of a pickle (parallel dicts by article id: slot 2 headlines, 3 texts, 4 polarities), converted once to parquet in ``out``.

    The dicts are joined by article id.  A pickle is one file that one process must read; only trusted files may be given.
    """
    with open(path, "rb") as f:
        slots = pickle.load(f)
    headline, text, polarity = (pd.Series(slots[i], dtype=object) for i in (2, 3, 4))
    frame = pd.DataFrame({"headline": headline, "text": text, "polarity": polarity}).rename_axis("article_id").reset_index()
    frame["article_id"] = frame["article_id"].astype(str)
    spark.createDataFrame(frame, "article_id STRING, headline STRING, text STRING, polarity STRING").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def podcast_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per episode of a directory with a JSON file per channel, named ``polarity-channel_name.json``."""
    raw = spark.read.schema(f"title STRING, author STRING, episodes {EPISODES}").option("multiLine", True).json(path)
    name = F.regexp_extract("_metadata.file_name", r"^([^-]*)-(.*)\.json$", 1), F.regexp_extract("_metadata.file_name", r"^([^-]*)-(.*)\.json$", 2)
    rows = raw.select(name[0].alias("polarity"), name[1].alias("channel"), F.col("title").alias("channel_title"), "author", F.explode("episodes").alias("episode", "e"))
    return rows.select("episode", "polarity", "channel", "channel_title", "author", T.year_of(F.col("e.episode_date")).alias("year"), "e.*")


def podcasts(spark: SparkSession, metadata: str, transcripts: str) -> DataFrame:
    """Episodes with their transcripts: the transcript's file is the audio's with ``.json`` for ``.mp3``."""
    base = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.(mp3|json)$", "")
    meta = podcast_metadata(spark, metadata).withColumn("__f", base(F.col("file_path")))
    texts = spark.read.schema("text STRING").option("multiLine", True).json(transcripts).select("text", base(F.col("_metadata.file_name")).alias("__f"))
    return meta.join(texts, "__f").drop("__f")


def _tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A tab-separated file; all columns are text, as the header states them."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return df.select(*columns) if columns else df


def tweets(spark: SparkSession, raw: str, scores: list[str]) -> DataFrame:
    """One record per tweet with every score column (names in lower case, ``_`` for blanks).  A score of a tweet that isn't in ``raw`` raises when the rows are read."""
    out = keep_first(_tsv(spark, raw), ["id_str"], ["text"])
    ids = out.select("id_str")
    for path in scores:
        table = _tsv(spark, path)
        table = table.toDF(*[c.lower().replace(" ", "_") for c in table.columns])
        known = table.join(ids.withColumn("__known", F.lit(True)), "id_str", "left")
        checked = known.withColumn("id_str", F.when(F.col("__known"), F.col("id_str")).otherwise(F.raise_error(F.concat(F.lit("unknown tweet "), "id_str")).cast("string"))).drop("__known")
        clash = [c for c in checked.columns if c in out.columns and c != "id_str"]
        out = out.join(keep_first(checked.drop(*clash), ["id_str"], ["id_str"]), "id_str", "left")
    return out


def tweets_frame(spark: SparkSession, raw: str, labels: str | None = None, threshold: float | None = None, processed: DataFrame | None = None) -> DataFrame:
    """Tweets with polarity (ideology up to 0 is left, the rest, unknown included, right).

    With ``labels`` only labelled tweets, once each, of at least ``threshold``; with ``processed`` only those in it.
    """
    base = keep_first(_tsv(spark, raw).withColumn("ideology", F.col("ideology").try_cast("double")), ["id_str"], ["text"])
    if labels:
        marked = keep_first(_tsv(spark, labels, ["id_str", "text", "percent_yes"]).withColumn("percent_yes", F.col("percent_yes").try_cast("double")), ["id_str"], ["text"])
        base = marked.join(base.select("id_str", "ideology"), "id_str", "left")
        if threshold is not None:
            base = base.where(F.col("percent_yes") >= threshold)
    if processed is not None:
        base = only(base, processed.select("id_str"), ["id_str"])
    return base.withColumn("polarity", F.when(F.col("ideology") <= 0, "left").otherwise("right"))


def lcc(spark: SparkSession, path: str) -> DataFrame:
    """Annotated instances of an XML file or directory: words of source and target with their places in the whole text, target concept, unanimous score or null.

    Read as whole files and cut into instances where they are read; places count from the start of the joined text.
    """
    raw = spark.read.option("wholetext", True).text(path)
    inst = raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<LmInstance\b.*?</LmInstance>)"), 1)).alias("x"))
    get = lambda tag: F.regexp_extract("x", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    attr = lambda name: F.regexp_extract("x", rf"<LmInstance[^>]*\b{name}=\"([^\"]*)\"", 1)
    parts = inst.select(attr("id").alias("id"), attr("targetConcept").alias("target_concept"), get("Prev").alias("prev"), get("Current").alias("current"), get("Next").alias("next"), F.regexp_extract_all("x", F.lit(r"<MetaphoricityAnnotation\b[^>]*\bscore=\"([^\"]*)\""), 1).alias("scores"))
    shift = F.when(F.col("prev") == "", 0).otherwise(F.char_length("prev") + 1)
    cols = []
    for name, tag in (("source", "LmSource"), ("target", "LmTarget")):
        word, start, end = T.span_of(F.col("current"), tag)
        cols += [word.alias(f"{name}_string"), (start + shift).alias(f"{name}_char_start"), (end + shift).alias(f"{name}_char_end")]
    plain = F.regexp_replace("current", "<[^>]*>", "")
    text = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (F.col("prev"), plain, F.col("next"))])
    scores = F.transform("scores", lambda s: T.parse_score(s))
    return parts.select("id", "target_concept", text.alias("text"), *cols, F.when(F.size("scores") > 0, T.unanimous(scores)).alias("score"))


def load_raw(spark: SparkSession, dataset: str, **paths) -> DataFrame:
    """The raw frame of a dataset; the LCC sets have none."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset}")
    if dataset.startswith("lcc"):
        raise NotImplementedError("LCC has annotations only")
    if dataset == "podcasts":
        return podcast_metadata(spark, paths["metadata"])
    if dataset == "tweets_immigration":
        return tweets_frame(spark, **paths)
    frame = spark.read.schema("article_id STRING, headline STRING, text STRING, polarity STRING").parquet(paths["articles"])
    processed = paths.get("processed")
    frame = frame.select(F.col("article_id").alias("id"), "polarity")
    return only(frame, processed.select("id"), ["id"]) if processed is not None else frame


def chunked(docs: DataFrame, ident: str, text: str, limit: int = 42_000) -> DataFrame:
    """Documents cut into chunks: ``doc_id``, ``chunk_idx``, ``text``; annotations still join on ``doc_id``."""
    cut = T.chunks(limit)
    return docs.select(F.col(ident).alias("doc_id"), F.posexplode(cut(T.collapse_nbsp(F.col(text)))).alias("chunk_idx", "text"))


def annotations(docs: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """Columns of a wide frame as annotation rows with their key ``document_type``; nulls give none."""
    long = docs.select(F.col(ident).cast("string").alias("document_id"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["document_id"], columns, "annotation_type", "annotation_value")
    return long.where("annotation_value IS NOT NULL").select(F.concat_ws("_", "document_id", "annotation_type").alias("id"), "document_id", "annotation_type", "annotation_value")


def csv_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id STRING, text STRING, source_word STRING, target_word STRING").option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def pickled_vectors(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Vectors of a pickle ``{index: {id, emb, text}}``, converted once to parquet; trusted files only."""
    with open(path, "rb") as f:
        data = pickle.load(f)

    def rows() -> Iterator[tuple]:
        for i, r in data.items():
            yield int(i), r["id"], [float(x) for x in r["emb"]], r.get("text")

    spark.createDataFrame(list(rows()), "idx INT, id STRING, emb ARRAY<FLOAT>, text STRING").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
