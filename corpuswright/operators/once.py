"""Columns that are worked out once, whatever is asked of them later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with these columns as finished values for all steps above. Where a filter or an explosion is put on a column
    of a projection, Spark moves the condition below it with the column's expression in the place of its name; over steps
    that name each other several times that multiplies. No condition on what an explosion gives moves below it, and this
    one has a row for each row."""
    z = F.explode(F.array(F.struct(*columns)))
    others = [c for c in df.columns if c not in columns]
    rows = df.select(*others, z.alias("_once"))
    return rows.select(*[F.col(f"_once.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
