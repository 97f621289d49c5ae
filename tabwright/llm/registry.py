"""The queries of this subpackage, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def llm_query(name: str, table: str, sql: str | None = None):
    """Register ``fn(whole table, folder) -> DataFrame``."""

    def register(fn):
        LLM_QUERIES[name] = lambda spark, folder: fn(spark.read.parquet(f"{folder}/{table}.parquet"), folder)
        if sql is not None:
            LLM_SQL[name] = sql.strip()
        return fn

    return register
