"""Corpus pipeline: quality rules, near-duplicates, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each stage's result as Parquet in the
shared folder and reads it as the next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.llm import mixing, pieces, quality, simhash
from corpuswright.llm.common import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules of the newest policy keep, with all their columns as they are.

    Defined results: a null or empty text has no words and is rejected; a null doc_id is like any other; repeated rows
    each get their own verdict; columns named like a measurement keep their values; an empty table stays empty."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "doc_id", "text")
    return quality.judged(quality.ledger(rows)).where("kept").select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, texts that share about 0.8 of their 5-word shingles or are linked by
    such: that with the smallest doc_id.

    Defined results: rows without a doc_id stand for their group only if it has no other; rows of different groups stay,
    also where they share a doc_id or have none; of rows that share doc_id and text one stays; texts without words are one
    group; texts of any length are compared whole; all columns keep their names and values; an empty table stays empty."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; those it takes no times are gone.

    Defined results: a null source is a source of its own; texts without words have no mass and are rounded on their own;
    rows equal in all columns share their copies; a text of any length is one item; all columns keep their names and
    values; an empty table stays empty."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, piece_ids, n_pieces and lossless of every row, sampled by doc_id.

    Defined results: a null or empty text has no pieces; equal rows get equal pieces; texts of any length are encoded whole;
    only doc_id, source and text are read, so other columns may have any name; an empty table stays empty."""
    coded = pieces.encoded(docs, more=("source",))
    return coded.select(F.col("key").alias("doc_id"), "source", "piece_ids", "n_pieces", "lossless")


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Pivotal rounding and sampled segmentations are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
