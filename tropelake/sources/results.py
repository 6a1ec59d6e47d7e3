"""Annotation results, configurations, result directories and exports."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..schemas import ANSWERS, DATASETS


def llm_results(spark: SparkSession, path: str, task: str) -> DataFrame:
    """Rows of result files ``{data: {id: {text, source_word, target_word, annotation}}}``: one file or a directory of them."""
    answer = ", ".join(f.replace(" ", ": ", 1) for f in ANSWERS[task].split(", "))
    item = f"STRUCT<text: STRING, source_word: STRING, target_word: STRING, annotation: STRUCT<{answer}>>"
    raw = spark.read.schema(f"data MAP<STRING, {item}>").option("multiLine", True).json(path)
    return raw.select(F.explode("data").alias("id", "r")).select("id", "r.*")


def _parts(df: DataFrame) -> list:
    i = F.col("id")
    return ["id", ids.document(i).alias("doc_id"), ids.sentence(i).alias("sent_idx"), ids.part(i, 2).alias("path_id")]


def metaphor_classes(results: DataFrame) -> DataFrame:
    """Words in lower case without outer blanks and ``llm_met_class``; an answer that is neither literal nor metaphorical is False and ``invalid``."""
    label = F.lower(F.trim("annotation.classification"))
    valid = F.coalesce(label.isin("literal", "metaphorical"), F.lit(False))
    word = lambda c: F.lower(F.trim(c)).alias(c)
    return results.select(*_parts(results), word("source_word"), word("target_word"), F.coalesce(label == "metaphorical", F.lit(False)).alias("llm_met_class"), (~valid).alias("invalid"))


def metaphor_scores(results: DataFrame) -> DataFrame:
    return results.select(*_parts(results), "source_word", "target_word", F.col("annotation.metaphor_salience_score").alias("llm_met_score"))


def target_groups(results: DataFrame) -> DataFrame:
    return results.select(*_parts(results), "target_word", F.col("annotation.target_group").alias("target_group"))


def classification_results(spark: SparkSession, folder: str, dataset: str, metaphors_only: bool = False, with_ads: bool = False) -> DataFrame:
    if with_ads and dataset != "podcasts":
        raise ValueError("only podcasts have ads")
    rows = metaphor_classes(llm_results(spark, f"{folder}/{dataset}{'_with_ads' if with_ads else ''}.json", "metaphor_class"))
    return rows.where("llm_met_class") if metaphors_only else rows


def scored_results(spark: SparkSession, path: str, metaphors_only: bool = False, threshold: float = 0.4) -> DataFrame:
    rows = metaphor_scores(llm_results(spark, path, "metaphor_score"))
    return rows.where(F.col("llm_met_score") >= threshold) if metaphors_only else rows


def map_json(df: DataFrame, key: str, path: str) -> None:
    """Rows as JSON lines ``{key: {other columns}}``, written in parallel; null keys drop out."""
    rest = F.struct(*[c for c in df.columns if c != key])
    line = F.to_json(F.create_map(F.col(key).cast("string"), rest))
    df.where(F.col(key).isNotNull()).select(line.alias("value")).write.mode("overwrite").text(path)


def read_map_json(spark: SparkSession, key: str, schema: str, path: str) -> DataFrame:
    """What ``map_json`` wrote: ``key`` and the columns of ``schema``."""
    item = ", ".join(f.strip().replace(" ", ": ", 1) for f in schema.split(","))
    rows = spark.read.text(path).select(F.explode(F.from_json("value", f"MAP<STRING, STRUCT<{item}>>")).alias(key, "r"))
    return rows.select(key, "r.*")


def annotated_documents(spark: SparkSession, docs: DataFrame, annotations: DataFrame, kinds: list[str], path: str, renew: bool = False) -> DataFrame:
    """Documents with a column for each kind of annotation, worked out once and kept in ``path``."""
    from ..operators.relational import attributes_wide

    if renew or not _there(spark, path):
        wide = attributes_wide(annotations, "document_id", "annotation_type", "annotation_value", kinds).withColumnRenamed("document_id", "id")
        docs.join(wide, "id", "left").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at.suffix("/_SUCCESS"))


def create_tables(spark: SparkSession, path: str) -> None:
    """Every table of the data model that isn't in ``path`` yet, empty."""
    from .. import schemas

    for name in ("documents", "sentences", "tokens", "chains", "mentions", "doc_annotations", "sent_annotations"):
        if not _there(spark, f"{path}/{name}"):
            spark.createDataFrame([], getattr(schemas, name.upper())).write.parquet(f"{path}/{name}")


def load_or_make(spark: SparkSession, path: str, make, renew: bool = False) -> DataFrame:
    """The table in ``path``; made and written first where it isn't there."""
    if renew or not _there(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def separate_export(examples: DataFrame, solutions: DataFrame, path: str) -> None:
    """Examples as a tab-separated file of JSON without their answers, and the solutions apart."""
    shown = examples.select("example_id", F.to_json(F.struct(*[c for c in examples.columns if c != "example_id"])).alias("example"))
    shown.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/examples")
    solutions.write.mode("overwrite").parquet(f"{path}/solutions")


def store_report(df: DataFrame, path: str, label: str, k: int, w_cl: float | None = None) -> None:
    """A report or weights of one run, as a partition of the result table."""
    tagged = df.withColumns({"label_name": F.lit(label), "k": F.lit(k), "w_cl": F.lit(w_cl).cast("double")})
    tagged.write.mode("append").partitionBy("label_name", "k", "w_cl").parquet(path)


def collect_reports(spark: SparkSession, path: str) -> DataFrame:
    """All runs below ``path``; label, k and weight come from the partitions."""
    return spark.read.parquet(path)


def by_file_name(spark: SparkSession, path: str, schema: str, pattern: str = r"_k?(\d+)(?:_w[\d.]+)?\.csv$") -> DataFrame:
    """Frames of a directory with ``k`` from each file's name."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.withColumn("k", F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("int"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Cannot-link pairs, smaller index first, each once."""
    pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where("i < j").distinct().write.mode("append").parquet(path)


def has_pairs(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Which of the pairs asked for are stored, in either order."""
    a = asked.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return a.join(stored.select("i", "j").distinct(), ["i", "j"], "left_semi")


@dataclass(frozen=True)
class Experiment:
    """Settings of a run and the places that follow from them."""

    dataset: str
    results: str
    task_type: str
    task_name: str
    labeled_only: bool = False
    seed: int = 42
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.dataset not in DATASETS:
            raise ValueError(f"unknown dataset {self.dataset}")
        if self.labeled_only and self.dataset != "tweets_immigration":
            raise ValueError("only tweets have hand labels")

    @property
    def out_name(self) -> str:
        return self.dataset + ("_labeled" if self.labeled_only else "")

    @property
    def out(self) -> str:
        return f"{self.results}/{self.task_type}/{self.task_name}"

    def partition(self) -> str:
        return f"{self.results}/task={self.task_name}/dataset={self.dataset}/labeled={str(self.labeled_only).lower()}"

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @staticmethod
    def load(path: str) -> Experiment:
        return Experiment(**json.loads(Path(path).read_text()))


@dataclass(frozen=True)
class ProviderOptions:
    """What a model provider is told."""

    model: str
    temperature: float = 0.0
    workers: int = 8
    save_interval: int = 100
    max_retries: int = 5

    @staticmethod
    def from_yaml(path: str) -> ProviderOptions:
        """A flat file of ``name: value`` lines; a section's name indents its entries."""
        values: dict = {}
        for line in Path(path).read_text().splitlines():
            name, _, value = line.split("#")[0].strip().partition(":")
            if value.strip() and name in ProviderOptions.__dataclass_fields__:
                kind = {"model": str, "temperature": float}.get(name, int)
                values[name] = kind(value.strip().strip("\"'"))
        return ProviderOptions(**values)


def prompt_file(path: str) -> dict:
    """``system_prompt``, ``question`` and ``demos`` of a prompt file; prompts are data and stay outside of the code."""
    data = json.loads(Path(path).read_text())
    return {"system_prompt": data.get("system_prompt", ""), "question": data["question"], "demos": data.get("demos", [])}
