"""Resumable annotation by model providers.

A provider is a function from an iterator of frames (id, prompt) to frames (id, answer), the answer as JSON or null.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.text import fill
from ..schemas import ANSWERS, DOMAINS

#: What each task is asked, as a template over columns.
TEMPLATES = {
    "metaphor_class": "Source Word: {source_word}\nTarget Word: {target_word}\nSentence: {sentence}",
    "noun_type": "Noun: {target_word}\nSentence: {sentence}",
    "target_group": "Noun: {target_word}\nSentence: {sentence}\nGroups: {groups}",
    "groups": "Words: {words}",
    "clean_groups": "Groups: {groups}",
    "image_schema": "Verb: {source_word}\nExamples: {examples}",
    "entailments": "Source Word: {source_word}\nTarget Word: {target_word}\nSentence: {sentence}",
    "ad_class": "Sentence: {sentence}",
}
#: The forms of a candidate in a prompt, by whether verbs are asked for and whether the target is shown.
CANDIDATES = {
    (True, True): "Specified Verb: '{source_word}'\n Target Noun: '{target_word}'\n Sentence: '{sentence}'",
    (True, False): "Specified Verb: '{source_word}'\n Sentence: '{sentence}'",
    (False, True): "Source Word: '{source_word}'\nTarget Word: '{target_word}\n Sentence: '{sentence}'",
    (False, False): "Potential Source Word: '{source_word}'\n Sentence: '{sentence}'",
}
TASK_DOMAIN = {"metaphor_class": ("classification", "metaphor_class"), "noun_type": ("noun_classification", "noun_classification"), "image_schema": ("image_schema_group", "image_schema_group"), "ad_class": ("classification", "ad_class")}


def prompt(task: str, question: str = "", **values: Column) -> Column:
    """The question, a new line and the filled template."""
    body = fill(TEMPLATES[task], **values)
    return F.concat(F.lit(question + "\n"), body) if question else body


def candidate_prompt(verbs: bool = True, target: bool = False, **values: Column) -> Column:
    """A candidate as the prompts show it: a verb or any source word, with or without its target."""
    return fill(CANDIDATES[verbs, target], **values)


def with_demos(text: Column, demos: list[dict], shots: int, seed: int = 42) -> Column:
    """Up to ``shots`` worked examples before the prompt: none for 0, a sample by lot of more than that, all of fewer."""
    if not shots or not demos:
        return text
    lots = sorted(demos, key=lambda d: hashlib.md5(f"{json.dumps(d, sort_keys=True)}|{seed}".encode()).hexdigest())[:shots]
    return F.concat(F.lit("".join(f"{d['text']}\n{json.dumps(d['answer'])}\n\n" for d in lots)), text)


def stub_provider(task: str, seed: int = 42) -> Callable:
    """Answers by lot from the prompt's hash: deterministic, offline, of the task's type."""
    field, domain = TASK_DOMAIN.get(task, (None, None))
    fields = [(f.name, f.dataType.typeName()) for f in _parse_datatype_string(ANSWERS[task]).fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["prompt"]:
                lot = int(hashlib.md5(f"{text}|{seed}".encode()).hexdigest()[:8], 16)
                values = {"string": f"answer {lot % 97}", "double": lot % 101 / 100, "array": [f"group {lot % 7}"], "map": {f"group {lot % 7}": "group"}}
                answer = {n: values[t] for n, t in fields}
                if field:
                    answer[field] = DOMAINS[domain][lot % len(DOMAINS[domain])]
                out.append(json.dumps(answer))
            yield pd.DataFrame({"id": frame["id"], "answer": out})

    return run


def annotate(items: DataFrame, ident: str, text: Column, task: str, provider: Callable, done: DataFrame | None = None, retries: int = 5, workers: int | None = None) -> DataFrame:
    """``id`` and ``annotation`` of what ``done`` doesn't have yet.

    Every answer is read with the task's schema; one that doesn't fit, or lies outside the task's values, is asked for
    again up to ``retries`` times and is then null.  ``workers`` sets how many tasks ask at once.
    """
    rows = items.select(F.col(ident).cast("string").alias("id"), text.alias("prompt"))
    if done is not None:
        rows = rows.join(done.select(F.col("id").cast("string").alias("id")), "id", "left_anti")
    if workers:
        rows = rows.repartition(workers)
    needed = {f.name for f in _parse_datatype_string(ANSWERS[task]).fields}
    field, domain = TASK_DOMAIN.get(task, (None, None))

    def fits(answer: str | None) -> bool:
        try:
            value = json.loads(answer)
            return needed <= set(value) and (field is None or str(value[field]).lower() in DOMAINS[domain])
        except (TypeError, ValueError):
            return False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            left, got = frame, {}
            for _ in range(retries):
                if not len(left):
                    break
                for part in provider(iter([left])):
                    got.update({i: a for i, a in zip(part["id"], part["answer"]) if fits(a)})
                left = left[~left["id"].isin(got.keys())]
            yield pd.DataFrame({"id": frame["id"], "answer": [got.get(i) for i in frame["id"]]})

    answered = rows.mapInPandas(run, "id STRING, answer STRING")
    return answered.select("id", F.from_json("answer", ANSWERS[task]).alias("annotation"))


def answer_schema(task: str) -> StructType:
    if task not in ANSWERS:
        raise ValueError(f"unknown task {task}")
    return _parse_datatype_string(ANSWERS[task])


def drop_failed(results: DataFrame) -> DataFrame:
    return results.where("annotation IS NOT NULL")


def matching(results: DataFrame, field: str, value: str) -> DataFrame:
    """Results whose answer has a value, whatever its case: what a chained prompt goes on with."""
    return results.where(F.lower(F.col(f"annotation.{field}")) == value.lower())


def annotate_saved(items: DataFrame, ident: str, text: Column, task: str, provider: Callable, path: str, every: int = 100, **options) -> DataFrame:
    """``annotate`` in rounds of about ``every`` rows for each worker, each appended to ``path`` when it is done.

    A run that stops loses one round; the next one goes on with what ``path`` doesn't have.  A row goes to a round by the
    hash of its identifier.
    """
    from ..sources.results import _there

    spark = items.sparkSession
    left = items
    if _there(spark, path):
        done = spark.read.parquet(path).select(F.col("id").alias("__done"))
        left = items.join(done, F.col(ident).cast("string") == F.col("__done"), "left_anti")
    workers = options.get("workers") or 1
    rounds = max(1, -(-left.count() // (every * workers)))
    for turn in range(rounds):
        part = left.where(F.pmod(F.xxhash64(F.col(ident).cast("string")), F.lit(rounds)) == turn)
        annotate(part, ident, text, task, provider, **options).write.mode("append").parquet(path)
    return spark.read.parquet(path)
