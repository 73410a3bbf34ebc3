"""Readers of the Parquet tables; one path rule for every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` under ``sf_dir``; with ``columns``, only these are scanned."""
    frame = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return frame.select(*columns) if columns else frame
