"""Corpus analytics on Spark: text metrics, longitudinal statistics, scoring and streaming ingest."""
