"""Columns of several steps are worked out once, also where a filter or an explosion is put on them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuswright.functions.rules import JA
from corpuswright.operators import lint, markdown
from corpuswright.operators.once import once
from corpuswright.plans import catalogue

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_does_not_repeat_the_column(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "k int, t string").withColumn("u", F.upper("t"))
    rows = once(df, "u").where(F.length("u") > 0)
    assert optimized(rows).count("upper(") == 1
    assert rows.columns == ["k", "t", "u"] and [tuple(r) for r in rows.collect()] == [(1, "a b", "A B")]
    assert once(df, "u").count() == 3


def test_filters_and_explosions_on_markdown_do_not_multiply(spark):
    df = spark.createDataFrame([("# a\nb\n\n> c\n```\nd\n```",)], "t string").withColumn("t", F.reverse("t")).withColumn("t", F.reverse("t"))
    for rows in (
        markdown.decomposed(df, "t").where(F.size("md.body_lines") > 0),
        markdown.decomposed(df, "t").select(F.posexplode("md.paragraphs")),
        lint.findings(df, "t", JA).select(F.explode("findings")),
    ):
        assert optimized(rows).count("reverse(") <= 40


@pytest.mark.parametrize("name", ["ja_decorations_of_one_length", "ja_density", "ja_lexical_window", "ja_nominal", "ja_nominal_tails", "ja_structure", "ja_targets", "ja_lint_rates", "ja_decorations_monthly", "ja_headings"])
def test_the_made_text_is_made_once_a_scan(spark, name):
    plan = optimized(catalogue.queries()[name](spark, SF))
    assert plan.count("translate(") == 1


def test_codes_are_those_of_the_line_table(spark):
    texts = ["```Py \na\n  b\n```\nx\n~~~\n```", "```\n\n```\n```\n```", "no code", "", None, "```x\nopen", "a\r\n```\r\nb c\n```"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = {(r["key"], r["lang"], r["code"], r["n_lines"]) for r in markdown.code_texts(markdown.line_table(df, "k", "t")).collect()}
    got = [(r["k"], *r["z"]) for r in markdown.coded(df, "t").select("k", F.explode("codes").alias("z")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_word_timeline_counts_words_once(spark):
    plan = optimized(catalogue.queries()["word_timeline"](spark, SF))
    assert plan.count("regexp_extract_all(") == 1
