"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import casestudy, evaluation, models, relational, text, vectors  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL
from .text import token_statistics


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_statistics(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
