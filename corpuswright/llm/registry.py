"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import audio, html, lm, mixing, packing, pieces, quality, search, sharding, simhash, tokencount, trie, warc

Query = Callable[[SparkSession, str], DataFrame]


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op10(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.op11(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.op12(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op13(table(spark, sf_dir, "documents", "doc_id", "text"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op2(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op3(spark, table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.op4(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.op5(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op6(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op7(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op8(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Query]:
    return {
        "op10_lm_scoring": op10_lm_scoring,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_ranked_search": op12_ranked_search,
        "op13_packing": op13_packing,
        "op1_mix_sources": op1_mix_sources,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_warc_index": op3_warc_index,
        "op4_token_counts": op4_token_counts,
        "op5_audio_fingerprints": op5_audio_fingerprints,
        "op6_sharding": op6_sharding,
        "op7_html_extraction": op7_html_extraction,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_quality_rules": op9_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_ranked_search": search.OP12_SQL, "op3_warc_index": warc.OP3_SQL, "op6_sharding": sharding.OP6_SQL, "op9_quality_rules": quality.OP9_SQL}
