"""Registered queries of the engine: each a callable (spark, sf_dir) over the driver's tables, and its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.storage import ensure_importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_importable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from tessera.queries import capsules, evolution, graph, mining, search, sequences, state, tables, text, transcripts, upkeep  # noqa: F401

    return QUERIES, SQL
