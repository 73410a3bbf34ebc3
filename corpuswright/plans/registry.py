"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that DuckDB runs on the same tables."""

    def put(query: Query) -> Query:
        if query.__name__ in QUERIES:
            raise ValueError(f"two queries are named {query.__name__}")
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return put
