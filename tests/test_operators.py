from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpuswright.functions.rules import JA, LATIN
from corpuswright.operators import lint, markdown, panel, tokens
from corpuswright.sources import ingest
from corpuswright.sources.days import read_days
from corpuswright.sources.ingest import ARTICLES
from corpuswright.streaming import jobs

SF = "/root/testdata/sf0.001"
MD = "# T\np1\n- i\np2\n```py\nx\n```\np3\n\n> q\n| t |\np4"


def test_decompose():
    got = markdown.decompose(MD)
    assert got["body_lines"] == ["p1", "p2", "p3", "p4"]
    assert [len(got[k]) for k in ("headings", "list_items", "table_rows", "code_lines", "quote_lines")] == [1, 1, 1, 3, 1]
    assert got["paragraphs"] == [["p1", "p2", "p3"], ["p4"]]
    assert markdown.decompose(None) == {k: [] for k in got}


def test_decomposed_udf_equals_loop(spark):
    rows = spark.createDataFrame([(1, MD), (2, None), (3, "")], "id int, text string")
    for r in markdown.decomposed(rows, "text").collect():
        assert r.md.asDict() == markdown.decompose(r.text)


def test_lines_and_blocks(spark):
    text = "```Py\na\nb\n```\n> q1\n> q2\n\n> q3\n  - deep\n1. first\n~~~\nopen"
    lines = markdown.line_table(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id", "text")
    assert [tuple(r) for r in markdown.code_blocks(lines).select("lang", "n_lines").collect()] == [("py", 2)]
    got = markdown.structure(lines).first()
    assert (got.quote_blocks, got.quote_lines, got.list_items, got.nested_items, got.ordered_items) == (2, 3, 2, 1, 1)


def rows(spark, values):
    return spark.createDataFrame([(k, a, dt.datetime.fromisoformat(c), c[:7], float(v), 0) for k, (a, c, v) in enumerate(values)], "id int, author int, created timestamp, month string, value double, likes int")


def test_shift_share_identities(spark):
    data = rows(spark, [(1, "2020-01-01", 1), (1, "2020-02-01", 3), (2, "2020-02-01", 5), (1, "2020-03-01", 2), (3, "2020-03-02", 4), (2, "2020-03-05", 9)])
    r = panel.composition(data, F.col("month") == "2020-02", F.col("month") == "2020-03").first()
    assert r.comp_a + r.within_b == pytest.approx(r.total)
    assert r.comp_b + r.within_a == pytest.approx(r.total)
    assert r.comp_a + r.within_a + r.interaction == pytest.approx(r.total)


def test_semi_and_anti_are_the_whole(spark):
    data = rows(spark, [(1, "2020-01-01", 1), (None, "2020-02-01", 3), (2, "2020-02-01", 5), (1, "2020-02-02", 2)])
    feb, jan = F.col("month") == "2020-02", F.col("month") == "2020-01"
    back = panel.returning(data, feb, jan).count()
    new = data.where(feb).join(panel.authors_of(data, jan), "author", "left_anti").count()
    assert back == 1
    assert back + new == 3
    assert panel.one_per_author(data).count() == 3


def test_slopes_and_bridge(spark):
    yearly = spark.createDataFrame([(2020, 1.0), (2022, 3.0), (2023, 10.0), (2026, 16.0)], "year int, v double")
    assert panel.slopes(yearly, 2022).first().pre_slope == 1.0
    assert panel.slopes(yearly, 2022).first().post_slope == 3.25
    assert panel.slopes(yearly, 2022, bridge=False).first().post_slope == 2.0


def test_bootstrap_gates(spark):
    def interval(authors, empty=0):
        rows = [(side, f"{side}{k}", None if k < empty else float(k)) for side in "ab" for k in range(authors if side == "b" else 6)]
        df = spark.createDataFrame(rows, "period string, author string, value double")
        return panel.bootstrap(df, F.col("period") == "a", F.col("period") == "b", 40).first()

    assert interval(4).low is interval(4).high is None
    assert interval(5).low < interval(5).high
    assert interval(6, empty=6).low is None


def test_breach_and_layers(spark):
    r = spark.range(1).select(panel.breach(F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("a"), panel.breach(F.lit(1.1), F.lit(1.0), F.lit(0.0)).alias("b"), *[panel.layer_of(F.lit(k)).alias(f"k{k}") for k in (0, 1, 2, 3, 9, 10)]).first()
    assert tuple(r) == (False, True, "0", "1-2", "1-2", "3-9", "3-9", "10+")


def test_iso_week(spark):
    r = panel.weekly(spark.createDataFrame([(dt.datetime(2024, 12, 30), 1.0)], "ts timestamp, value double"), least=1).first()
    assert (r.week, r.week_start) == ("2025-W01", "2024-12-30")


def test_empty_panel(spark):
    none = rows(spark, [(1, "2020-01-01", 1)]).where("id < 0")
    assert panel.timeline(none).count() == 0
    assert panel.seasonal_gaps(none).count() == 0
    assert panel.debut_profile(none).count() == 0


def test_log_odds(spark):
    a, b = (spark.createDataFrame(x, "word string, freq long") for x in ([("x", 3), ("y", 1)], [("x", 1), ("y", 3)]))
    z = {r.word: r.z for r in tokens.log_odds(a, b).collect()}
    assert z["x"] == pytest.approx(-1.8884525156)
    assert z["y"] == pytest.approx(1.8884525156)


def test_tokenizer_failures_are_rows(spark):
    def bad():
        def tokenize(text):
            if "boom" in text:
                raise ValueError(text)
            return tokens.simple_tokenizer(text)

        return tokenize

    got = tokens.tokenized(spark.createDataFrame([(1, "a b"), (2, "boom"), (3, None)], "id int, text string"), "text", bad).orderBy("id").collect()
    assert [len(r.tokens or []) for r in got] == [2, 0, 0]
    assert [r.tokens_error for r in got] == [None, "ValueError", None]


def test_pos_shares(spark):
    made = [("設計", "設計", "名詞", "サ変可能", "漢"), ("検証", "検証", "名詞", "サ変可能", "漢"), ("する", "する", "動詞", "", "和"), ("木", "木", "名詞", "", "和")]
    df = tokens.tokenized(spark.createDataFrame([(1, "x")], "id int, text string"), "text", lambda: lambda _: made)
    r = df.select(*[c.alias(n) for n, c in tokens.pos_shares(F.col("tokens")).items()]).first()
    assert r["pos_名詞_ratio"] == 0.75
    assert r.sahen_noun_ratio == pytest.approx(2 / 4)
    assert r.kango_ratio == pytest.approx(2 / 4)
    assert r.sahen_verb_per_1000 == 250
    assert r.sahen_case_per_1000 == 0
    assert r.sahen_chain_per_1000 == 250


def test_lint(spark):
    text = "心が折れる 枝が折れる。" + "、".join("あいう") + "。" + "短い文。" * 10
    find = lambda options, phrases=None: lint.findings(spark.range(1).withColumn("t", F.lit(text)), "t", JA, options, phrases).first().findings
    assert "cv" not in {f.rule for f in find(lint.LintOptions(disabled=frozenset(["cv"])))}
    assert find(lint.LintOptions(min_sentences=100)) == []
    hits = find(lint.LintOptions(), {"short": "短い"})
    assert [f.value for f in hits if f.rule == "phrase"] == [10.0]
    assert spark.range(1).select(F.regexp_count(F.lit(text), F.lit("(?<!心が|心は)折れる"))).first()[0] == 1
    deep, shallow = lint.LintOptions(limits={"ten": 9}), lint.LintOptions(limits={"ten": 9}, shallow=True)
    assert deep.limit("bold") == 13.0
    assert shallow.limit("bold") == 4.329
    assert lint.LintOptions(limits={"ten": 9}, shallow=True, lower="p25").limit("cv") == 0.532
    got = {f.rule: f for f in find(lint.LintOptions(limits={"ten": 0.1, "kanji": 0.1}))}
    assert (got["ten"].message, got["ten"].place, got["kanji"].place) == ("above", "below", "far above")
    assert lint.found(lint.findings(spark.createDataFrame([(1, None), (2, "")], "k int, t string"), "t", JA), "k").count() == 0


def test_autofix_in_turn(spark):
    r = spark.range(1).select(lint.autofix(F.lit("aab"), [("a+", "b"), ("bb", "c")]).alias("t"), lint.fix_counts(F.lit("aab"), [("a+", "b"), ("bb", "c")]).alias("n")).first()
    assert tuple(r) == ("c", 2)


def test_ingest_plan(spark):
    manifests = spark.createDataFrame([("2024-02-01", True), ("2024-02-02", False)], "date string, complete boolean")
    days = ingest.target_days(spark, ["2024-02", "2024-02"])
    assert days.count() == 29
    assert ingest.days_to_fetch(days, manifests).count() == 28
    assert ingest.days_to_fetch(days, manifests, force=True).count() == 29


def test_fetch_day_retries_and_stops():
    calls, slept = [], []

    def page(day, number):
        calls.append(number)
        if calls == [1]:
            return 429, {"rate-reset": "0"}, []
        return 200, {"rate-remaining": "900"}, [{"n": number}] * (2 if number < 3 else 1)

    got = list(ingest.fetch_day(dt.date(2024, 1, 1), page, per_page=2, sleep=slept.append))
    assert len(got) == 5
    assert calls == [1, 1, 2, 3]
    assert slept == [1.0]


def test_first_days_counts_existing_days(spark):
    df = spark.createDataFrame([("a", d) for d in (3, 3, 9, 20)] + [("b", 1)], "p string, d int")
    assert sorted(map(tuple, ingest.first_days(df, F.col("p"), F.col("d"), 2).collect())) == [("a", 3), ("a", 3), ("a", 9), ("b", 1)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.json").write_text('{"date": "2024-01-01", "fetched": 1, "complete": true}')
    (tmp_path / "m" / "2.json").write_text("{broken")
    assert [r.date for r in ingest.read_manifests(spark, str(tmp_path / "m")).collect()] == ["2024-01-01"]
    (tmp_path / "a.jsonl").write_text('{"id": "x", "tags": ["t"]}\n')
    r = ingest.read_articles(spark, str(tmp_path / "a.jsonl"), label="2024-01").first()
    assert (r.id, r.tags, r.label) == ("x", ["t"], "2024-01")


def test_split_sink_keeps_all(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01", None), (2, "2024-01", "short"), (3, "2024-02", None)], "id int, month string, reason string")
    for _ in range(2):  # again: the same months are replaced
        ingest.write_split(df, "reason", str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "part=kept")).count() + spark.read.parquet(str(tmp_path / "part=excluded")).count() == 3


def test_paged_source_has_a_partition_a_day():
    reader = ingest.PagedSource({"address": "x", "first": "2024-01-30", "last": "2024-02-02"}).reader(None)
    assert [p.value for p in reader.partitions()] == ["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-02"]


def test_pending_jobs(spark):
    queue = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "job string")
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    log = spark.createDataFrame([("a", "claimed", at(0)), ("a", "done", at(1)), ("b", "failed", at(1)), ("c", "claimed", at(0)), ("d", "claimed", at(19))], "job string, state string, at timestamp")
    got = {r.job for r in jobs.pending_jobs(queue, log, "2024-01-01 00:20:00").collect()}
    assert got == {"b", "c"}
    parts = [{r.job for r in jobs.part_of(queue, k, 2).collect()} for k in range(2)]
    assert parts[0] | parts[1] == {"a", "b", "c", "d"}
    assert not parts[0] & parts[1]


def test_incremental_ingest(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.json").write_text('{"id": "x", "created_at": "2024-01-01T00:00:00+09:00"}\n')
    for _ in range(2):
        jobs.ingest(spark, str(source), target, str(tmp_path / "cp")).awaitTermination()
    (source / "2.json").write_text('{"id": "y", "created_at": "2024-01-02T00:00:00+09:00"}\n')
    jobs.ingest(spark, str(source), target, str(tmp_path / "cp")).awaitTermination()
    assert read_days(spark, target, ARTICLES).count() == 2


def test_latin_rules_are_used():
    assert LATIN.stops != JA.stops


def test_a_day_in_two_batches(spark, tmp_path):
    def put(name, *records):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"id": i, "title": t, "created_at": "2024-02-01T00:00:00Z", "updated_at": u}) for i, t, u in records))
        jobs.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    put("a.json", ("1", "old", "2024-02-01"), ("2", "kept", "2024-02-05"))
    put("b.json", ("1", "new", "2024-02-03"), ("2", "stale", "2024-02-02"), ("3", "more", None))
    got = read_days(spark, str(tmp_path / "out"), ARTICLES).collect()
    assert {(r.id, r.title) for r in got} == {("1", "new"), ("2", "kept"), ("3", "more")}
    assert len(got) == 3


def test_documents_configs_and_logs(spark, tmp_path):
    (tmp_path / "one.md").write_text("# T\n\nbody\n")
    assert [r.body for r in ingest.read_markdown(spark, str(tmp_path / "one.md")).collect()] == ["# T\n\nbody\n"]
    spread = {"description": "d", "p10": 0, "p25": 1, "p50": 2, "p75": 3, "p90": 4, "direction": "low_is_suspicious", "zero_ratio": 0.5}
    (tmp_path / "profile.json").write_text(json.dumps({"metrics": {"ten": spread}}))
    assert tuple(ingest.read_profile(spark, str(tmp_path / "profile.json")).first()) == ("ten", 0.0, 1.0, 2.0, 3.0, 4.0, 0.5, "low")
    (tmp_path / "series.json").write_text(json.dumps({"years": ["2020", "2021"], "words": [{"word": "x", "series": [1, None]}]}))
    assert [(r.word, r.year, r.value) for r in ingest.read_series(spark, str(tmp_path / "series.json")).orderBy("year").collect()] == [("x", "2020", 1.0), ("x", "2021", None)]
    (tmp_path / "lexicon.json").write_text("\n".join(json.dumps({"word": w}) for w in ("b", "a", "b", None)))
    assert [r.word for r in ingest.read_lexicon(spark, str(tmp_path / "lexicon.json")).orderBy("rank").collect()] == ["b", "a"]
    rows = spark.createDataFrame([("b", 2.0), ("a", None)], "word string, z double")
    ingest.write_document(rows, str(tmp_path / "doc"), ["word"], title="t")
    assert ingest.read_config(spark, str(tmp_path / "doc")) == {"title": "t", "rows": [{"word": "a", "z": None}, {"word": "b", "z": 2.0}]}
    ingest.write_lines(rows, str(tmp_path / "lines"))
    assert sorted(spark.read.text(str(tmp_path / "lines")).toPandas().value) == ['{"word":"a","z":null}', '{"word":"b","z":2.0}']
    log, entry = str(tmp_path / "log"), lambda *x: spark.createDataFrame([x], "job string, state string")
    for batch, state in (("1", "claimed"), ("2", "done"), ("2", "failed")):
        ingest.append_log(entry("j", state), log, batch)
    assert {(r.state, r.batch) for r in ingest.read_log(spark, log, "job string, state string").collect()} == {("claimed", "1"), ("failed", "2")}
    with pytest.raises(ValueError, match="batch"):
        ingest.append_log(entry("j", "x"), log, "a/b")


def test_views_and_as_of(spark):
    ingest.register_views(spark, "/root/testdata/sf0.001", ["nation", "region"], "t_")
    assert spark.sql("SELECT count(*) AS n FROM t_nation JOIN t_region ON n_regionkey = r_regionkey").first().n == 25
    rows = spark.createDataFrame([("1", "2024-01-01", "2024-03-01"), ("2", "2024-02-20", "2024-02-21"), ("3", "2024-05-01", "2024-05-01")], "id string, created_at string, updated_at string")
    assert {tuple(r) for r in ingest.as_of(rows, "2024-02-25").collect()} == {("1", "2024-01-01", "2024-01-01", True), ("2", "2024-02-20", "2024-02-21", False)}


def test_manifests_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"date": "2024-01-01",\n "fetched": 3, "complete": true}')
    (tmp_path / "b.json").write_text('{"date": ')
    assert [(r.date, r.fetched) for r in ingest.read_manifests(spark, str(tmp_path)).select("date", "fetched").collect()] == [("2024-01-01", 3)]


def test_slim_and_manifest_write(spark):
    raw = spark.createDataFrame([("1", "t", ["x"])], "id string, title string, names array<string>").selectExpr(
        "id", "title", "'b' AS body", "'2024-01-01T00:00' AS created_at", "'u' AS updated_at", "1L AS likes_count", "0L AS stocks_count", "0L AS comments_count", "false AS private", "false AS coediting", "false AS slide", "'url' AS url",
        "named_struct('id', 'a', 'followees_count', 1L, 'followers_count', 2L, 'items_count', 3L) AS user", "transform(names, n -> named_struct('name', n)) AS tags",
    )
    got = ingest.slim(raw)
    assert (got.first().user_items_count, got.first().tags) == (3, ["x"])
    totals = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 12_000)], "date string, api_total_count long")
    assert {(r.date, r.complete, r.truncated_at_10k) for r in ingest.manifests_of(got, totals).collect()} == {("2024-01-01", True, False), ("2024-01-02", False, True)}
    labels = spark.createDataFrame([("2024-01",), ("2024-01-first",), ("x",)], "label string")
    assert [r.label for r in ingest.monthly_labels(labels).collect()] == ["2024-01"]


def test_days_that_go_on_and_faults():
    day = dt.date(2024, 1, 1)
    page = lambda d, n: (200, {"link": '<x>; rel="next"' if n < 3 else '<x>; rel="prev"'}, [{"n": n}] * 2)
    assert len(list(ingest.fetch_day(day, page, per_page=2, sleep=lambda _: None))) == 6
    endless = lambda d, n: (200, {}, [{"n": n}] * 2)
    got = ingest.fetch_day(day, endless, per_page=2, pages=3, sleep=lambda _: None)
    assert sum(1 for _ in zip(range(6), got)) == 6
    with pytest.raises(ingest.Truncated):
        next(got)
    assert ingest.http_page("http://127.0.0.1:9/none", None) == (599, {}, [])


def test_long_texts_in_a_process_of_their_own(spark):
    def factory():
        def tokenize(text):
            if text.startswith("crash"):
                import os

                os._exit(139)
            if text.startswith("hang"):
                import time

                time.sleep(60)
            if text.startswith("boom"):
                raise ValueError(text)
            return tokens.simple_tokenizer(text)

        return tokenize

    rows = [(1, "fine " * 30), (2, "crash " * 30), (3, "hang " * 30), (4, "boom " * 30), (5, "short")]
    got = tokens.tokenized(spark.createDataFrame(rows, "id int, text string"), "text", factory, isolate=100, timeout=2.0).orderBy("id").collect()
    assert [len(r.tokens or []) for r in got] == [30, 0, 0, 0, 1]
    assert [r.tokens_error for r in got] == [None, "ChildProcessError", "TimeoutError", "RuntimeError", None]
