"""Characters looked up as arrays: classes counted in one pass, and letters put in the place of others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import japanese as J
from corpuswright.functions import rules as R
from corpuswright.functions import text as T
from corpuswright.operators.rewrite import translated
from corpuswright.plans import catalogue
from corpuswright.plans.japanese_queries import _kinds

SF = "/root/testdata/sf0.001"
TEXTS = ["設計がは abc 12ー、カタ", "", None, "𠮷野家😀ab", "é\x00\n- ", "aAbB" * 3000, "。、を" * 5000]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_classes_are_counted_together(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    classes = [*_kinds.values(), "[a-cB]", "[-x]", "[b]"]
    each = [T.count_of(F.col("t"), p) for p in classes]
    for r in df.select("t", T.class_counts(F.col("t"), classes).alias("a"), F.array(*each).alias("b")).collect():
        assert r.a == (None if r.t is None else r.b)
    with pytest.raises(ValueError, match="𠮷"):
        T.class_counts(F.col("t"), ["[𠮷]"])


def test_letters_are_translated(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    pairs, letters, to = {"ab": "X計 ", "計": "b"}, "abbeéX- 1A", "設かYう😀"[:4]
    x = F.col("t")
    for a, b in pairs.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    got = df.select(translated(F.col("t"), pairs, letters, to).alias("a"), F.translate(x, letters, to).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


@pytest.mark.parametrize("name", ["ja_char_classes", "ja_char_classes_weekly", "ja_char_classes_within"])
def test_a_text_is_looked_through_once_for_its_classes(spark, name):
    plan = optimized(catalogue.queries()[name](spark, SF))
    assert plan.count("counts(") == 1 and plan.count("translate(") == 1
    assert not any(p in plan for p in _kinds.values())


def test_patterns_are_counted_together(spark):
    texts = [*TEXTS, "心が折れた折れた折れていない折れている、折れてない", "設計計だけはだけは設計だけはカナカナカナカナカナカナカナだけは", "私たちは我々が私たち、は", "したがって\n従って\nx従って\n", "**a** **b\n** __c__ **𠮷**__d\n__ ****", "証拠では ない証拠ではない根拠とはならない"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [*J.PHRASES.values(), R.BOLD, "[一-鿿]", "[𠮷-𠮸]", "(?i)A", "a?", r"\s", "(a|b)+", "a++b", "[^a、]{2,3}?", "\\p{Lu}", "[一-鿿]"]
    each = [F.regexp_count("t", F.lit(p)) for p in patterns]
    for r in df.select("t", F.array(*T.counts_of(F.col("t"), patterns, J.needed)).alias("a"), F.array(*each).alias("b")).collect():
        assert r.a == r.b


def test_sentences_are_trimmed_of_all_white_space(spark):
    cases = [f"a{c}b{c}{c}。{c}c{c}\n{c}" for c in [chr(k) for k in range(1, 0x3100) if chr(k) not in "。！？!?、，"]]
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    parts = F.split(F.regexp_replace(F.regexp_replace("t", "(?U)([、，])\\s*\\R\\s*", "$1"), "[。！？!?]", "$0\n"), "[\\n-\\r\\x85\\u2028\\u2029]+")
    plain = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")), lambda x: x != "")
    for r in df.select("t", T.sentences(F.col("t"), R.JA).alias("a"), plain.alias("b")).collect():
        assert r.a == r.b, repr(r.t)


def test_phrases_pass_once(spark):
    """One search for all phrases but the one that means something else to Python."""
    plan = optimized(catalogue.queries()["ja_lint_findings"](spark, SF))
    assert plan.count("hits(") == 1 and plan.count("counts(") == 1
    assert not any(p in plan for p in J.PHRASES.values() if "(?m)" not in p)
