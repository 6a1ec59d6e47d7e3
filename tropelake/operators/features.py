"""Joins of annotations into metaphor features, embeddings and the cluster export."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize_label
from .ranking import running_total
from .relational import overlay


def metaphor_features(mets: DataFrame, noun_types: DataFrame, groups: list[DataFrame], schemas: DataFrame, accepted: list[str]) -> DataFrame:
    """``id`` and ``features`` of each metaphor: noun type, cleaned target group, schema of its source verb (two hops).

    ``groups`` are tables (id, target_group) of which the last wins; without a group the features are null.
    """
    group = overlay(groups, ["id"]).select("id", sanitize_label(F.col("target_group"), accepted).alias("target_group"))
    out = mets.join(noun_types.select("id", "noun_classification"), "id", "left").join(group, "id", "left")
    out = out.join(schemas.select("source_word", F.col("image_schema_group").alias("source_image_schema_group")), "source_word", "left")
    struct = F.struct("noun_classification", "target_group", "source_image_schema_group")
    return out.select("id", F.when(F.col("target_group").isNotNull(), struct).alias("features"))


def verb_examples(mets: DataFrame, n: int = 3) -> DataFrame:
    """``source_word`` with its first ``n`` examples as structs, in order of id."""
    w = Window.partitionBy("source_word").orderBy("id")
    few = mets.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return few.groupBy("source_word").agg(F.array_sort(F.collect_list(F.struct("id", "sentence", "target_word"))).alias("examples"))


def group_dictionary(groups: DataFrame) -> DataFrame:
    """``noun_type`` with a map from its groups to their definitions; repeated ones once."""
    return groups.groupBy("noun_type", "target_group").agg(F.min("definition").alias("definition")).groupBy("noun_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target_group", "definition")))).alias("groups"))


def group_text(groups: DataFrame) -> DataFrame:
    """The dictionary as lines of text: ``noun_type`` and ``text``, a line ``group: definition`` for each group, in order."""
    each = F.transform(F.array_sort(F.map_entries("groups")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return group_dictionary(groups).select("noun_type", F.array_join(each, "\n").alias("text"))


def dense_index(df: DataFrame, order: str) -> DataFrame:
    """``idx`` 0, 1, … in order of a column without ties, without one task for all rows."""
    return running_total(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", "idx").drop("__one")


def stub_embedder(dim: int = 64) -> Callable:
    """Hashed bags of words, of length 1: deterministic and offline."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for frame in frames:
            out = []
            for text in frame["text"]:
                v = np.zeros(dim, np.float32)
                for w in (text or "").lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1 if h >> 16 & 1 else -1
                n = np.linalg.norm(v)
                out.append(v / n if n else v)
            yield pd.DataFrame({"id": frame["id"], "text": frame["text"], "emb": out})

    return run


#: What a metaphor's embedding may be made of.
TEXTS = ("explanation", "entailments", "sentence", "document")
FRAMES = ("problem_def", "cause", "moral_eval", "treatment_rec")


def embedding_texts(kind: str, rows: DataFrame) -> DataFrame:
    """``id`` and ``text`` for one of ``TEXTS``: the answer's explanation, the four entailments as one paragraph (of ``annotation``), the sentence (what follows ``Sentence: `` of a prompt), or the whole document.  Rows without a text drop out; of several rows of an id the smallest text stays."""
    from ..functions.text import after_marker, joined_values

    if kind not in TEXTS:
        raise ValueError(f"texts are {', '.join(TEXTS)}")
    prompt = after_marker(F.col("text"), "Sentence: ") if "text" in rows.columns else F.lit(None).cast("string")
    text = {
        "explanation": lambda: F.col("annotation.explanation"), "entailments": lambda: joined_values(F.col("annotation"), list(FRAMES)),
        "sentence": lambda: F.col("sentence") if "sentence" in rows.columns else F.coalesce(prompt, F.col("text")), "document": lambda: F.col("text"),
    }[kind]()
    return rows.select(F.col("id").cast("string").alias("id"), text.alias("text")).where("text <> ''").groupBy("id").agg(F.min("text").alias("text"))


def stub_word_vectors(dim: int = 64, reach: int = 3) -> Callable:
    """For frames (id, text, word) a vector of the word in its sentence: its own hash with those of its neighbours; null if the word isn't there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import zlib

        for frame in frames:
            out = []
            for text, word in zip(frame["text"], frame["word"]):
                words = re.findall(r"\w+", (text or "").lower())
                places = [i for i, w in enumerate(words) if word and w == word.lower()]
                v = np.zeros(dim, np.float32)
                for i in places:
                    for w in words[max(0, i - reach) : i + reach + 1]:
                        h = zlib.crc32(w.encode())
                        v[h % dim] += (1 if h >> 16 & 1 else -1) * (3 if w == words[i] else 1)
                n = np.linalg.norm(v)
                out.append(v / n if places and n else None)
            yield pd.DataFrame({"id": frame["id"], "emb": out})

    return run


def word_vectors(df: DataFrame, ident: str, text: str, word: str, provider: Callable) -> DataFrame:
    """``id`` and ``emb``, the vector of a word in its context; rows without one drop out."""
    rows = df.select(F.col(ident).cast("string").alias("id"), F.col(text).alias("text"), F.col(word).alias("word"))
    return rows.mapInPandas(provider, "id STRING, emb ARRAY<FLOAT>").where("emb IS NOT NULL")


def embed(df: DataFrame, ident: str, text: str, provider: Callable) -> DataFrame:
    rows = df.select(F.col(ident).cast("string").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    return rows.mapInPandas(provider, "id STRING, text STRING, emb ARRAY<FLOAT>")


def cluster_export(assignments: DataFrame, embeddings: DataFrame, features: DataFrame, classes: DataFrame, entailments: DataFrame, docs: DataFrame, importance: DataFrame, distances: DataFrame) -> DataFrame:
    """The star join behind the export: an outer lookup of every table by its id, sorted by importance and distance where it is written.

    Nothing is broadcast by hint: adaptive execution does it for the sides that turn out small.
    """
    out = assignments.join(embeddings.select("idx", "id", "text"), "idx").join(distances.select("idx", "distance"), "idx", "left")
    out = out.join(features.select("id", "features"), "id", "left").join(classes.select("id", "source_word", "target_word", "sentence"), "id", "left")
    out = out.join(entailments.select("id", "entailment_text"), "id", "left").withColumn("doc_id", F.substring_index("id", "_", 1))
    out = out.join(docs, "doc_id", "left").join(importance.select(F.col("cluster").alias("label"), F.col("importance_rank").alias("clust_imp_rank")), "label", "left")
    return out.select(F.col("id").alias("met_id"), "distance", F.col("label").alias("cluster"), "clust_imp_rank", "features.*", "source_word", "target_word", "sentence", "entailment_text", *[c for c in docs.columns if c != "doc_id"])
