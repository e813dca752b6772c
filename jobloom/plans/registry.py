"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobloom.sources.inputs import duckdb_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plan(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``key``; without ``sql`` only its rows are checked."""

    def register(query: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = duckdb_sql(sql)
        return query

    return register
