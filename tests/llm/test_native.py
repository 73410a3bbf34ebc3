"""Quality rules, mixing and sharding."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from corpuswright.llm import mixing, quality, sharding
from corpuswright.llm.common import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "a b c d a b c x b c d", "x\nx\n\nx\ny", "x " * 500, "É é b #1 $2 |", "w" * 100_000, "a b c " * 3000 + "tail",
    "　 wide\x0bvertical\x0cfeed\rreturn", "same line\n same line\nsame line",
]


def frame(spark, values, columns="doc_id long, text string"):
    return spark.createDataFrame(values, columns)


def plain(text):
    words, full = WORD.findall(text or ""), text or ""
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines = [x for x in full.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in full), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark):
    got = quality.op9(frame(spark, list(enumerate(TEXTS)))).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(TEXTS[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality, "HASH", -1 << 62)  # four hashes for all windows
    texts = ["a b c d a b c e f g h a b d", "a b c a b c", "p q r s t u v w x y z " * 3, "k l m n o k l m x y z l m n"]
    for r in quality.op9(frame(spark, list(enumerate(texts)))).collect():
        assert r.n_repeat_words == plain(texts[r.doc_id])[4], texts[r.doc_id]


def test_ledger_keeps_rows_columns_and_policies(spark):
    df = frame(spark, [(None, "x", 1), (None, "x", 1), (2, None, None)], "doc_id long, text string, n_words int")
    book = quality.ledger(df)
    assert book.count() == 3
    assert {r.n_words for r in book.collect()} == {0, 1}
    assert quality.judged(book, 1).where("kept").count() == 0
    assert quality.ledger(df.where("false")).count() == 0


def test_ablation(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(1, good), (2, "few"), (3, good + " $$$$$$$$$$$$$$$$$$$$$$"), (4, "few $$$")]
    got = {r.rule: (r.failed, r.failed_alone) for r in quality.ablation(quality.ledger(frame(spark, rows))).collect()}
    assert got["symbols"] == (2, 1)
    assert got["too_few_words"] == (2, 1)
    assert got["digits"] == (0, 0)


def mixture(spark):
    rows = [(k, f"s{k % 5}" if k % 7 else None, "w " * (1 + k * k % 97)) for k in range(2000)]
    return frame(spark, rows, "doc_id long, source string, text string")


def test_mix_meets_targets(spark):
    df = mixture(spark)
    got = mixing.op1(df).collect()
    assert len(got) == 2000
    by = {}
    for r in got:
        assert r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    size = {s: sum(r.size for r in by[s]) for s in order}
    weight, total = {s: 1 + k % 3 for k, s in enumerate(order)}, sum(size.values())
    capped = set()
    while True:  # reshare until none is above its cap
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and weight[s] * level > 3 * size[s]}
        if not new:
            break
        capped |= new
    for s in order:
        want = 3 * size[s] if s in capped else weight[s] * level
        assert by[s][0].target == pytest.approx(want)
        assert by[s][0].source_size == size[s]
        assert abs(sum(r.taken for r in by[s]) - want) <= max(r.size for r in by[s])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.op1(df.repartition(7)).collect()), key=str)


def test_mix_marginals(spark):
    """Over seeds, a document is taken as often as its share says."""
    df = frame(spark, [(k, "a" if k < 40 else "b", "w " * (k % 7 + 1)) for k in range(80)], "doc_id long, source string, text string")
    rows = df.select(F.col("doc_id").alias("key"), "source", mixing.count_words(F.col("text")).alias("size"))
    n, total = 12, {}
    for seed in range(n):
        for r in mixing.plan(rows, seed).collect():
            total[r.key] = total.get(r.key, 0) + r.copies / (r.target / r.source_size)
    assert sum(total.values()) / (80 * n) == pytest.approx(1, abs=0.08)


def test_mix_edges(spark):
    shape = "doc_id long, source string, text string, key int, copies int"
    df = frame(spark, [(1, "a", None, 1, 2), (2, None, "", 1, 2), (3, "a", "x y", 5, 6)] + [(None, "a", "dup dup", 0, 0)] * 6, shape)
    assert mixing.mix(df).columns == df.columns
    assert mixing.op1(df).count() == 9
    assert mixing.op1(df.where("false")).count() == 0
    assert mixing.mix(df.where("false")).count() == 0
    copies = [r.copies for r in mixing.op1(df).where("doc_id is null").collect()]
    assert max(copies) - min(copies) <= 1


def test_compaction_keeps_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), 5).alias("text"), F.lit(None).cast("int").alias("file"))
    store = sharding.ShardStore(spark, scratch(spark, "t"), target=1 << 20, unit=1 << 13)
    for k in range(6):
        store.append(df.where(F.col("doc_id") % 6 == k).repartition(2))
        before = store.manifest().count()
        store.compact()
        assert store.manifest().count() <= before
    got = store.read(df.schema)
    assert got.count() == 5000
    assert got.exceptAll(df).count() == 0
    due = store.tiers().where("tier is not null").groupBy("tier").count().where(f"count >= {store.fan}")
    assert due.count() == 0
    old = store.version()
    assert store.read(df.schema, 1).count() < 5000
    assert store.vacuum() > 0
    assert store.version() == old
    assert store.read(df.schema).count() == 5000


def test_commit_is_exclusive(spark):
    store = sharding.ShardStore(spark, scratch(spark, "t"))
    store.append(spark.range(3).toDF("x"))
    with pytest.raises(Exception, match="AlreadyExists"):
        store._commit(store.manifest(), 0)
    assert store.version() == 1


def test_sharding_edges(spark):
    df = frame(spark, [(1, None), (1, None), (None, "x")])
    assert sorted(map(str, sharding.op6(df).select("doc_id", "n_chars").collect())) == sorted(map(str, df.select("doc_id", F.length("text").cast("long").alias("n_chars")).collect()))
    assert sharding.op6(df.where("false")).count() == 0


def test_two_writers_of_one_version(spark):
    """Of writers that commit at once, one makes the version, and the other may try again."""
    store = sharding.ShardStore(spark, scratch(spark, "t"))
    store.append(spark.range(3).toDF("x"))
    made = [f"{store.folder}/data/{k}" for k in range(4)]
    for k, folder in enumerate(made):
        spark.range(k + 1).toDF("x").write.parquet(folder)

    def commit(folder):
        try:
            return store._commit(store.manifest(1).unionByName(store.described(folder)), 1)
        except Exception as error:
            return str(error)

    with ThreadPoolExecutor(4) as pool:
        results = list(pool.map(commit, made))
    assert results.count(2) == 1
    winner = results.index(2)
    assert store.read(store.spark.range(0).toDF("x").schema).count() == 3 + winner + 1
    store.adopt(made[(winner + 1) % 4])
    assert store.version() == 3


def test_shards_keep_columns_named_like_their_own(spark):
    df = frame(spark, [(k, k % 3, f"x{k}") for k in range(50)], "doc_id long, _arrival int, tier string")
    store = sharding.compacted(df)
    assert sorted(map(tuple, store.read(df.schema).collect())) == sorted(map(tuple, df.collect()))
