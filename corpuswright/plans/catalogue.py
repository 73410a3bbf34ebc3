"""Every registered query with its SQL twin."""

from __future__ import annotations

from . import battery_queries, japanese_queries, more_queries, panel_queries, sql_queries, stream_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
