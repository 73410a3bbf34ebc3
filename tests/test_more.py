from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from corpuswright.functions import japanese
from corpuswright.operators import checks, nominal, render, rewrite, tokens

DOC = "# R\n\n| month | chars | n |\n|---|---|---|\n| 2020-08 | 993 | 1.5 |\n| 2020-09 | 1,000 | x |\n\nAbout 12,000 articles, then 500 articles. See [a](./b.md) and [c](../c/d.md), [e](http://x)."


def test_table_cells_and_mismatches(spark):
    docs = spark.createDataFrame([("docs/a.md", DOC)], "path string, text string")
    cells = checks.table_cells(docs, "path", "text")
    assert {(r.row, r.header, r.cell) for r in cells.collect()} == {("2020-08", "chars", "993"), ("2020-08", "n", "1.5"), ("2020-09", "chars", "1,000"), ("2020-09", "n", "x")}
    measured = spark.createDataFrame([("2020-08", "chars", 993.4), ("2020-08", "n", 1.56), ("2020-09", "chars", 1000.0)], "row string, header string, value double")
    assert [(r.row, r.header) for r in checks.mismatches(cells, measured).collect()] == [("2020-08", "n")]


def test_claims_and_links(spark):
    docs = spark.createDataFrame([("docs/a.md", DOC)], "path string, text string")
    assert [r.claim for r in checks.scale_claims(docs, "path", "text", "articles", [11_800.0]).collect()] == ["500"]
    files = spark.createDataFrame([("docs/b.md", 10), ("c/other.md", 900_000)], "path string, length long")
    assert [r.target for r in checks.broken_links(docs, files, "path", "text").collect()] == ["c/d.md"]
    assert checks.large_files(files).count() == 1


def test_round_trip(spark):
    words = ["設計", "検証", "実装"]
    jobs = spark.createDataFrame([(1, 2020, "これは設計についての文で、とても長い文になっています。"), (2, 2020, "設計と検証の両方が入っている長い文なので対象になりません。"), (3, 2021, "boom 検証 という語が入った日本語の文でとても長いものです。")], "id int, year int, s string")
    ok = rewrite.eligible(jobs, "s", words)
    assert sorted(r.id for r in ok.collect()) == [1, 3]

    def translate(text):
        if "boom" in text:
            raise OSError
        return text.replace("設計", "検証")

    done = rewrite.round_trip(ok, "s", translate, 2)
    assert sorted((r.id, r.state) for r in done.collect()) == [(1, "done"), (3, "failed")]
    changed = rewrite.changes(done.where("state = 'done'"), "s", "after", words)
    r = changed.first()
    assert (r.lost, r.gained) == (["設計"], ["検証"])
    assert rewrite.survival(changed, 1).first().survival_pct == 0
    concepts = spark.createDataFrame([("設計", "work"), ("検証", "work"), ("木", "plant")], "word string, concept string")
    assert [tuple(r) for r in rewrite.replacements(changed, concepts).collect()] == [("設計", "検証", 1)]
    assert rewrite.replacements(changed, concepts.where("word = '木'")).count() == 0
    assert rewrite.vanished(changed).count() == 0
    assert rewrite.balanced(jobs, "year", "id", "s", 1).count() == 2


def test_nominal_endings(spark):
    made = {"これはとても良い設計。": ["名詞"], "これからすぐそこへ行く。": ["動詞"], "【第1章】とても良い設計。": ["名詞"], "は確認するための資料": ["名詞"], "設計。": ["名詞"], "- 一覧にした項目の設計": ["名詞"], "x = 1; y = 2 の良い設計": ["名詞"], "名前: とても良い設計と方法": ["名詞"], "abc defgh ijk の設計": ["名詞"]}
    rows = spark.createDataFrame([(1, 1, k, s, [{"surface": s[:-1] or s, "pos1": p[-1]}]) for k, (s, p) in enumerate(made.items())], "key int, paragraph int, pos int, sentence string, tokens array<struct<surface:string,pos1:string>>")
    got = {r.sentence: r.n for r in rows.select("sentence", japanese.is_nominal(F.col("sentence"), F.col("tokens")).alias("n")).collect()}
    assert [s for s, hit in got.items() if hit] == ["これはとても良い設計。"]
    found = nominal.contexts(rows.withColumn("nominal", japanese.is_nominal(F.col("sentence"), F.col("tokens"))))
    assert [r.position for r in found.orderBy("pos").collect()] == ["first", *["middle"] * 7, "last"]
    assert nominal.summary(found).first().first_pct == 100


def test_render(spark):
    assert render.sparkline([0, None, 7]) == "▁ █"
    assert render.sparkline([1, 1]) == "▄▄"
    assert render.percentile_bar(0)[0] == "●"
    df = spark.createDataFrame([("a|b", 1.5)], "x string, y double")
    assert render.table_lines(df, True).splitlines()[-1] == "| a\\|b | 1.5 |"
    svg = render.line_chart(["2020", "2021"], {"w<": [1.0, 2.0]}, "t", "2021")
    assert svg.count("<path") == 1
    assert "w&lt;" in svg
    series = spark.createDataFrame([("x",), ("ツール-tool",), ("ツール-a",), ("y-1",), ("y",)], "word string")
    wanted = spark.createDataFrame([("ツール",), ("y",), ("none",)], "name string")
    assert {r.name: r.word for r in render.resolved(wanted, series).collect()} == {"ツール": "ツール-a", "y": "y", "none": None}


def test_simple_tokenizer():
    assert [t[0] for t in tokens.simple_tokenizer("Ab 12, é")] == ["Ab", "12", ",", "é"]


def test_headers_name_measures(spark):
    headers = {"漢字率": "kanji_ratio", "**漢字率**": "kanji_ratio", "(漢字率": "kanji_ratio", "題の漢字率": None, "体言止め(1-25)": None, "体言止め差": None, "漢字率(12月)": None, "MTLD 中央": "mtld", "読点/文 倍": None, "件数": None}
    df = spark.createDataFrame([(h,) for h in headers], "h string")
    assert {r.h: r.f for r in df.select("h", checks.field_of(F.col("h")).alias("f")).collect()} == headers


def test_documents_are_verified_in_one_pass(spark):
    doc = "| 年 | 漢字率 | 体言止め差 |\n|---|---|---|\n| 2020 | 0.17 | 9 |\n| 2021 | 0.30 | 9 |\n\n| デビュー年 | 漢字率 |\n|---|---|\n| 2020 | 0.99 |\n"
    docs = spark.createDataFrame([("a.md", doc), ("b.md", "none"), ("c.md", None)], "path string, text string")
    measured = spark.createDataFrame([("2020", "kanji_ratio", 0.174), ("2021", "kanji_ratio", 0.231)], "row string, header string, value double")
    assert {tuple(r) for r in checks.verified(docs, "path", "text", measured).collect()} == {("a.md", 2, 1), ("b.md", 0, 0), ("c.md", 0, 0)}


def test_refused_calls_wait_longer():
    waits, left = [], [3]

    def call(text):
        if left[0]:
            left[0] -= 1
            raise rewrite.Refused
        return text.upper()

    assert rewrite.patient(call, jitter=0.0, sleep=waits.append)("a") == "A"
    assert waits == pytest.approx([3.0, 5.4, 9.72])
    left[0] = 99
    assert rewrite.patient(call, sleep=waits.append)("a") is None
    assert max(waits) <= 47


def test_japanese_tokens():
    found = tokens.simple_tokenizer("私は設計をテストします。")
    assert [t[0] for t in found] == ["私", "は", "設計", "を", "テスト", "します", "。"]
    assert [t[2] for t in found] == ["名詞", "助詞", "名詞", "助詞", "名詞", "助動詞", "補助記号"]


def test_claims_in_ten_thousands_and_deep_links(spark):
    docs = spark.createDataFrame([("a/b/c/d/e/f/g.md", "about 74万件, 81.1万記事, 811,379件 and 5件 [x](../../../../../../top.md) [y](./h.md) [z](../../../../../../../../out.md) [w](sub/../i//j.md)")], "path string, text string")
    got = [(r.claim, r.value) for r in checks.scale_claims(docs, "path", "text", ["件", "記事"], [811_379.0, 820_000.0], least=100.0).collect()]
    assert got == [("74万", 740_000.0)]
    assert {r.target for r in checks.relative_links(docs, "path", "text").collect()} == {"top.md", "a/b/c/d/e/f/h.md", "../../out.md", "a/b/c/d/e/f/i/j.md"}
