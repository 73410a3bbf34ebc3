"""Queries written in SQL alone, over the functions that ``functions.sql`` registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.sql import register_functions
from .registry import register
from .text_queries import MARKED, SENTS, documents, marked


@register(f"""WITH {MARKED}, n AS (SELECT kind, CASE kind WHEN 'code' THEN 3 ELSE 1 END AS lines FROM k)
SELECT kind, n FROM (SELECT kind, count(*) AS n FROM n GROUP BY 1 UNION ALL SELECT 'fence', 2 * count(*) FROM n WHERE kind = 'code')""")
def sql_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_functions(spark)
    return spark.sql("SELECT l.kind, count(*) AS n FROM {docs}, LATERAL md_lines(md) AS l GROUP BY l.kind", docs=marked(spark, sf_dir))


@register(f"""WITH {SENTS} SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g'))::INT AS chars, len(sents)::INT AS n_sentences, round(len(regexp_extract_all(text, ',')) / nullif(length(regexp_replace(text, '\\s', '', 'g')), 0) * 1000, 6) AS commas_per_1k, round(least(1.0, len(sents) / 30.0), 6) AS weight FROM s""")
def sql_doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_functions(spark)
    return spark.sql(
        """WITH s AS (SELECT doc_id, text, size(sentences_of(text, '.!?', ',')) AS n_sentences, solid_length(text) AS chars FROM {docs})
        SELECT doc_id, chars, n_sentences, round(per_thousand(regexp_count(text, ','), chars), 6) AS commas_per_1k, round(full_weight(n_sentences), 6) AS weight FROM s""",
        docs=documents(spark, sf_dir, "doc_id", "text"),
    )


@register("""SELECT source, sum(len(regexp_extract_all(text, '\\bthe\\b')))::BIGINT AS articles, sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS numbers, sum(len(regexp_extract_all(text, '[.!?]')))::BIGINT AS stops FROM documents GROUP BY 1""")
def sql_user_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that the query's author gives."""
    register_functions(spark)
    return spark.sql(
        r"""SELECT source, sum(articles) AS articles, sum(numbers) AS numbers, sum(stops) AS stops
        FROM {docs}, LATERAL pattern_counts(text, r'{{"articles": "\\bthe\\b", "numbers": "[0-9]+", "stops": "[.!?]"}}') AS p GROUP BY source""",
        docs=documents(spark, sf_dir, "source", "text"),
    )
