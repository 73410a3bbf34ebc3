"""Session settings shared by tests, benchmarks and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A local session in UTC with adaptive execution; on a cluster the submitter's settings are used instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpuswright")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in more.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
