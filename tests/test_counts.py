"""Counting without a string for each hit, and sentences without a look behind each letter."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswright.functions import japanese as J
from corpuswright.functions import text as T
from corpuswright.functions.rules import JA, LATIN

TEXTS = ["", None, "設計だけは設計だけは。", "漢字カナかなABC 1-2—――ー、，", "𠮷野家と漢字😀。", "a。b！？\r\n c d、\n e\x85\x0bf\x0c g。」h?!", "。。\n\n。", "とても良いな感じです。すごいな感じです", "作ることが可能ですすることが可能です"]


def test_counts_are_those_of_the_pattern(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    patterns = [*J.PHRASES.values(), *[p for p, _ in J.REPLACEMENTS], JA.ideograph, JA.letters, JA.kana, LATIN.ideograph, LATIN.kana, LATIN.letters, "[!-~]", "[、]", "[0-9]", "[ァ-ヶー]", J.CODE_SIGN]
    pairs = [F.struct(T.count_of(F.col("t"), p, J.needed(p)).alias("a"), F.regexp_count("t", F.lit(p)).alias("b")) for p in patterns]
    for row in df.select(F.array(*pairs).alias("z")).collect():
        assert [x["a"] for x in row["z"]] == [x["b"] for x in row["z"]]
    plan = df.select(T.count_of(F.col("t"), JA.kana))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    assert J.needed("(.{2,8})な感じです") == "な感じです" and J.needed(J.PHRASES["only"]) == "だけは" and J.needed("下記の") == ""


def test_sentences_end_where_they_did(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for rules in (JA, LATIN):
        joined = F.regexp_replace("t", f"(?U)([{rules.commas}])\\s*\\R\\s*", "$1")
        plain = F.filter(F.transform(F.split(joined, f"(?<=[{rules.stops}])|\\R"), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")), lambda x: x != "")
        for row in df.select(T.sentences(F.col("t"), rules).alias("a"), plain.alias("b")).collect():
            assert row["a"] == row["b"]
