"""Registry of named queries: name -> callable(spark, sf_dir), name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweir.plans import log_queries, run_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(log_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(log_queries.ORACLES)
