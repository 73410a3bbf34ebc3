"""Shares of tokens without a row for each token, nouns asked for first and once, and replacements in one pass."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from corpuswright.operators import markdown, tokens
from corpuswright.operators.rewrite import replaced
from corpuswright.plans import catalogue

SF = "/root/testdata/sf0.001"
TEXTS = ["設計設計が はを計画を、計が漢字 かな漢字 東京漢字漢字が", "カタカナabc漢 字Latin", "。、12 ー", "", None, "々漢字々", "が設計", "設計\n設計\nを"]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_replacements_in_turn(spark):
    pairs = {" a ": " b ", " b ": " c$1 ", "é": "日本"}
    df = spark.createDataFrame([(" a a a é",), ("a",), ("",), (None,), (" b a b ",)], "t string")
    x = F.col("t")
    for a, b in pairs.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    got = df.select(replaced(F.col("t"), pairs).alias("a"), x.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


@pytest.mark.parametrize("name", ["ja_structure", "ja_fixes", "ja_char_classes", "ja_lint_findings", "ja_char_classes_within"])
def test_the_made_text_is_searched_once_for_its_words_and_odd_breaks(spark, name):
    plan = optimized(catalogue.queries()[name](spark, SF))
    assert " という点です " not in plan and plan.count("Contains(") < 6


def test_odd_breaks_part_lines(spark):
    text = "".join(f"x{c}" for c in "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029\t\xa0") + "y"
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*(f"a{c}b" for c in text), text, "a\r\nb", None])], "k int, t string")
    by = lambda read: sorted(tuple(r) for r in read(df, "k", "t").collect())
    assert by(lambda *a: markdown.line_table(*a).select("key", "pos", "line")) == by(lambda *a: markdown.line_table_by_loop(*a).select("key", "pos", "line"))


@pytest.mark.parametrize("name", ["ja_nominal", "ja_nominal_tails"])
def test_nouns_are_asked_for_once(spark, name):
    plan = optimized(catalogue.queries()[name](spark, SF))
    assert plan.count("第[０-９0-9") == 1 and plan.count("TRAILING") <= 2


def token(x: str) -> dict:
    kanji, katakana, hiragana = "一" <= x[0] <= "鿿", "ァ" <= x[0] <= "ヶ" or x[0] == "ー", "ぁ" <= x[0] <= "ん"
    kind = "名詞" if kanji else "助詞" if x in "はがをに" else "未知語"
    return {"surface": x, "lemma": x, "pos1": kind, "pos3": "サ変可能" if kanji and len(x) > 1 else "", "goshu": "漢" if kanji else "外" if katakana else "和" if hiragana else ""}


def test_shares_by_marks_are_those_of_the_tokens(spark):
    rows = [(k, t, None if t is None else [token(x) for x in re.findall("[一-鿿]+|[ァ-ヶー]+|[ぁ-ん]|[A-Za-z]+", t)]) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, f"k int, t string, tokens {tokens.TOKEN}").withColumn("marks", tokens.script_marks(F.col("t")))
    by_marks, by_tokens = tokens.mark_shares(F.col("marks")), tokens.pos_shares(F.col("tokens"))
    for r in df.select(F.struct(*[c.alias(n) for n, c in by_marks.items()]).alias("a"), F.struct(*[by_tokens[n].alias(n) for n in by_marks]).alias("b"), F.length("marks").alias("n"), "tokens").collect():
        assert r.a == r.b
        assert r.n == (None if r.tokens is None else len(r.tokens))


@pytest.mark.parametrize("name", ["ja_density", "ja_lexical_window", "ja_targets"])
def test_tokens_are_no_structs(spark, name):
    assert "surface" not in optimized(catalogue.queries()[name](spark, SF))
