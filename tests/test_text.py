from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import japanese as J
from corpuswright.functions import text as T
from corpuswright.functions.rules import JA, LATIN
from corpuswright.operators import tokens


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


def test_sentences_join_after_comma(spark):
    assert one(spark, T.sentences(F.lit("今日は、\n\n  晴れ。明日？\n  雨"), JA)) == ["今日は、晴れ。", "明日？", "雨"]
    assert one(spark, T.sentences(F.lit(""), JA)) == []
    assert one(spark, T.sentences(F.lit(None).cast("string"), JA)) is None


def test_lengths(spark):
    assert one(spark, T.solid_length(F.lit("a　b c"))) == 3
    assert one(spark, T.mora(F.lit("きゃっと 来た"))) == 5


@pytest.mark.parametrize(("values", "want"), [([7, 70, 7, 70], -0.1), ([5], None), ([0, 0], None)])
def test_burstiness(spark, values, want):
    got = one(spark, T.burstiness(F.array(*[F.lit(float(v)) for v in values])))
    assert got == pytest.approx(want) if want is not None else got is None


@pytest.mark.parametrize(
    ("words", "want"), [(["a", "b"] * 25, 3.125), ([f"w{k}" for k in range(50)], 50.0), ((["a", "b", "c", "d", "e"] * 2) * 5, 7.142857142857143), (["a"] * 49, None)]
)
def test_mtld_native_and_loop(spark, words, want):
    assert tokens.mtld_of(words) == (pytest.approx(want) if want else None)
    native = one(spark, T.mtld(F.array(*map(F.lit, words))))
    assert native == (pytest.approx(want) if want else None)
    if want:
        assert tokens.mtld_of(words[::-1]) == pytest.approx(tokens.mtld_of(words))


@pytest.mark.parametrize(("value", "want"), [(0.0595, 5), (0.174, 50), (0.192, 62.5), (0.30, 95)])
def test_percentile(spark, value, want):
    p = [F.lit(x) for x in (0.119, 0.144, 0.174, 0.21, 0.249)]
    assert one(spark, T.percentile_of(F.lit(value), *p)) == pytest.approx(want)


def test_percentile_quirks(spark):
    p = [F.lit(x) for x in (-0.377, -0.305, -0.234, -0.156, -0.081)]
    assert one(spark, T.percentile_of(F.lit(-0.754), *p, compat=True)) == pytest.approx(20)
    assert one(spark, T.percentile_of(F.lit(-0.754), *p)) <= 10
    bold = [F.lit(x) for x in (0.0, 0.0, 0.0, 1.242, 4.329)]
    assert one(spark, T.percentile_of(F.lit(-1.0), *bold)) == 0
    assert one(spark, T.percentile_of(F.lit(0.0), *bold)) == 0


def test_percentile_is_monotone(spark):
    p = [F.lit(x) for x in (0.119, 0.144, 0.174, 0.21, 0.249)]
    rows = spark.range(0, 300).select(T.percentile_of(F.col("id") / 1000, *p).alias("p")).collect()
    values = [r.p for r in rows]
    assert values == sorted(values)


def test_clean_inline(spark):
    assert one(spark, T.clean_inline(F.lit("![a](u) [t](u) **b** <i>x</i>`c` end"))) == " t b x end"


@pytest.mark.parametrize(("title", "want"), [("2026-08-06 メモ", "date"), ("第3回", "series"), ("v2 入門", "version"), ("5選", "listing"), ("数字なし", None), ("98個溜まった", "other"), ("30分で分かる", "duration"), ("3つの方法", "listing"), ("Go 1つ", "other"), ("(2)", "series")])
def test_title_use(spark, title, want):
    assert one(spark, J.title_use(F.lit(title))) == want


@pytest.mark.parametrize(("block", "want"), [("※ 注", "callout"), ("Status Code: 401", "error"), ("出典: https://x", "sourced"), ("a" * 25, "foreign"), ("普通の文", "plain"), ("\U0001f914 名前\n「どう", "dialogue"), ("**AI**: 答え", "dialogue"), ("**注意**: 高温", "callout"), ("【検証日】八月", "callout"), ("npm install x", "code"), ("本文\n— 誰か", "sourced"), ("a" * 20, "plain")])
def test_quote_kind(spark, block, want):
    assert one(spark, J.quote_kind(F.lit(block))) == want


def test_domain_order_wins(spark):
    domains = {"Python/ML": ("python",), "Web": ("react",)}
    assert one(spark, T.first_domain(F.array(F.lit("React"), F.lit("Python")), domains, "other")) == "Python/ML"
    assert one(spark, T.first_domain(F.array(F.lit("Go")), domains, "other")) == "other"


@pytest.mark.parametrize(("seconds", "want"), [(0, "same"), (3599, "quick"), (3600, "later"), (-5, "quick")])
def test_edit_delay(spark, seconds, want):
    base = F.lit("2024-01-01 00:00:10").cast("timestamp")
    assert one(spark, T.edit_delay(base, F.timestamp_seconds(F.unix_timestamp(base) + seconds))) == want


def test_cut_at_stop(spark):
    assert one(spark, T.cut_at_stop(F.lit("あい。う"), 3)) == "あい。"
    assert one(spark, T.cut_at_stop(F.lit("あ。いう"), 3)) == "あ。い"  # the stop stands too early
    assert one(spark, T.cut_at_stop(F.lit("あいう"), 2)) == "あい"
    assert one(spark, T.cut_at_stop(F.lit("あい"), 2)) == "あい"


def test_exclusion_order(spark):
    no, yes = F.lit(False), F.lit(True)
    reason = lambda text, private=no, slide=no: one(spark, T.exclusion_reason(F.lit(text), F.lit("t"), private, slide, LATIN))
    assert reason("x", private=yes) == "private"
    assert reason("x", slide=yes) == "slide_mode"
    assert reason("  ") == "empty_body"
    assert reason("short") == "short_body"
    assert reason("1" * 400) == "other_script"
    assert reason("word " * 100) == "few_sentences"
    assert reason("A word and more. " * 50) is None


def test_japanese_endings(spark):
    s = F.array(F.lit("そうです。"), F.lit("そうだ。"), F.lit("はい"))
    assert one(spark, T.share_like(s, JA.polite)) == pytest.approx(1 / 3)
    assert one(spark, T.share_like(s, JA.plain)) == pytest.approx(1 / 3)
    assert one(spark, T.closing_heading(F.array(F.lit("## まとめ")), JA)) is True


def test_spark_line(spark):
    assert one(spark, F.concat(*[T.spark_line(F.lit(float(v)), F.lit(0.0), F.lit(7.0)) for v in (0, 3, 7)])) == "▁▄█"


def test_position_label(spark):
    p = [F.lit(x) for x in (1.0, 2.0, 3.0, 4.0, 5.0)]
    got = [one(spark, T.position_label(F.lit(float(v)), *p)) for v in (1, 1.5, 2, 3, 4, 4.5, 5)]
    assert got == ["far below", "below", "below", "usual", "above", "above", "far above"]


def test_memo_titles_and_topics(spark):
    for title, want in (("今日の日報", True), ("自分用メモ", True), ("メモリの話", False), ("Dockerのメモ", True)):
        assert one(spark, F.lit(title).rlike(J.MEMO_TITLE)) is want
    assert one(spark, J.about_topic(F.lit(None).cast("string"), F.array(F.lit("LLM")))) is True
    assert one(spark, J.about_topic(F.lit("gpt4 を使う"), F.array(F.lit("x")))) is True
    assert one(spark, J.about_topic(F.lit("設計"), F.array(F.lit("Go")))) is False


@pytest.mark.parametrize(("text", "n"), [("心が折れる 枝が折れる", 1), ("折れていない 折れてない 折れて", 1), ("折れます折れました", 2), ("心は折れた", 0)])
def test_lookbehind_phrase(spark, text, n):
    assert one(spark, T.count_of(F.lit(text), J.PHRASES["breaks"])) == n


def test_replacements_in_turn(spark):
    text = "下記のとおり、上記の表。重要なのは、画面の設計という点です。確認することが可能です。重要なのは処理を分けるという点です"
    for pattern, to in J.REPLACEMENTS:
        text = one(spark, F.regexp_replace(F.lit(text), pattern, to))
    assert text == "次のとおり、前述の表。重要なのは画面の設計です。確認できます。重要なのは処理を分けることです"
    assert len(J.REPLACEMENTS) == 23
    assert len(J.PHRASES) == 14
