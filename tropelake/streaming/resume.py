"""Annotation of new rows as they arrive: a stream over parquet files, in batches that survive a restart.

No windows or watermarks: the only state is which rows are done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotate import annotate
from ..schemas import ANSWERS


def annotate_available(spark: SparkSession, source: str, schema: str, ident: str, prompt: Callable[[], F.Column], task: str, provider: Callable, out: str, checkpoint: str, files_per_batch: int = 100) -> None:
    """Annotates all rows that ``source`` has and ``out`` doesn't, then ends.

    Each batch is joined against what is done and appended, so neither a restart nor a repeated delivery asks twice.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        done = spark.read.schema(f"id STRING, annotation STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in ANSWERS[task].split(', '))}>").parquet(out) if _exists(spark, out) else None
        once = df.dropDuplicates([ident])
        annotate(once, ident, prompt(), task, provider, done).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(where) and len(fs.listStatus(where)) > 0
