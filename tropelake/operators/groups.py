"""Groups of target nouns: contextual vectors, the best number of clusters, prompts from their typical members, and the answers' cleaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import annotate, clustering, metrics
from .features import word_vectors
from .ranking import top_share

#: What each corpus is about.
ISSUES = {"tweets_immigration": "U.S. Immigration", "subframes_abortion": "U.S. Abortion Rights", "subframes_guns": "U.S. Gun Control", "podcasts": "U.S. Politics"}


def noun_clusters(mets: DataFrame, noun_type: str, words: Callable, ks: range = range(5, 16), restarts: int = 50, components: int = 10) -> DataFrame:
    """``id``, ``label``, ``d2``, ``word``, ``sentence`` of the metaphors whose target is of a noun type (``id``, ``noun_classification``, ``target_word``, ``sentence``): vectors of the targets in context, without their first principal components, in the best number of clusters."""
    rows = mets.where(F.lower("noun_classification") == noun_type)
    vectors = clustering.without_top_components(word_vectors(rows, "id", "sentence", "target_word", words), "id", "emb", components).persist()
    labelled = clustering.best_k(vectors, "id", "vector", ks, restarts)[1]
    placed = metrics.with_distance(labelled, "label", "vector").drop("vector")
    return placed.join(rows.select(F.col("id").cast("string").alias("id"), F.col("target_word").alias("word"), "sentence"), "id")


def group_prompts(clusters: DataFrame, noun_type: str, dataset: str, nearest: float | None = 25) -> DataFrame:
    """``id`` and ``text``: a prompt for each cluster with its members, nearest first; all of them or the ``nearest`` percent."""
    rows = top_share(clusters, "label", ["d2", "id"], nearest) if nearest else clusters
    line = F.concat("word", F.lit(" -> "), "sentence")
    lists = rows.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d2", "id", line.alias("line")))).alias("m"))
    text = F.concat(F.lit(f"ISSUE: {ISSUES[dataset]}\nNOUNS:"), F.array_join("m.line", "\n"))
    return lists.select(F.concat(F.lit(f"{noun_type}_"), F.col("label").cast("string")).alias("id"), text.alias("text"))


def create_groups(mets: DataFrame, noun_type: str, dataset: str, words: Callable, answers: Callable, **options) -> DataFrame:
    """``id`` (type and cluster) and ``group``: the groups that the model names for each cluster."""
    prompts = group_prompts(noun_clusters(mets, noun_type, words, **options), noun_type, dataset)
    named = annotate.annotate(prompts, "id", F.col("text"), "groups", answers)
    return annotate.drop_failed(named).select("id", F.explode("annotation.groups").alias("group")).distinct()


def clean_groups(groups: DataFrame, answers: Callable) -> DataFrame:
    """``group`` and ``clean``: the model's names for all groups of one type, from a single prompt (a type has a few hundred groups at most)."""
    listed = groups.select(F.lower(F.btrim("group")).alias("group")).distinct().agg(F.array_sort(F.collect_list("group")).alias("g")).where(F.size("g") > 0)
    text = annotate.prompt("clean_groups", groups=F.array_join("g", "\n"))
    answer = annotate.annotate(listed.select(F.lit("groups").alias("id"), "g"), "id", text, "clean_groups", answers)
    return annotate.drop_failed(answer).select(F.explode("annotation.clean_groups").alias("group", "clean"))
