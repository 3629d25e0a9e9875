"""Registry of the library's queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import classify_queries, filing_queries, intake_queries, report_queries, stream_queries  # noqa: F401 - they register themselves
from .plans.registry import QUERIES, SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["w2_classify"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
