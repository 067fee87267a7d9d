"""Named queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import column_queries, event_queries, file_queries, model_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [event_queries, table_queries, model_queries, file_queries, column_queries]


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_queries.branch_gains_losses(spark, sf_dir)
