"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import account_queries, feature_queries, metric_queries, report_queries, scalar_queries, stream_queries, text_queries  # noqa: F401  (each module registers its queries)
from .registry import ORACLE_SQL, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["supplier_account_distribution"](spark, sf_dir)
