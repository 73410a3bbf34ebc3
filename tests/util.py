"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import decimal
import math
import os

import duckdb


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def same(df, con, sql):
    columns = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted("|".join(cell(r[k]) for k in at) for r in found.fetchall())
    got = sorted("|".join(cell(r[c]) for c in columns) for r in df.collect())
    assert got == want
