"""Registered queries: name to (Spark function, SQL for DuckDB or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def put(f: QueryFunction) -> QueryFunction:
        if f.__name__ in QUERIES:
            raise ValueError(f"registered twice: {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put
