"""The language model's contexts: each word has a restaurant of its own, however rare, wherever it is kept."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuswright.llm import lm


def trained(spark, texts, **more):
    return lm.train(spark.createDataFrame([(t, False) for t in texts], "text string, held_out boolean"), **more)


def scores(spark, model, texts):
    found = lm.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    return {texts[r.key]: r for r in found}


def split(monkeypatch, head, buckets):
    """Few words are frequent, and the others in several buckets."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "BUCKETS", buckets)
    monkeypatch.setattr(lm, "SPARSE", 1)


@pytest.mark.parametrize("head", [4096, 16])
def test_rare_contexts_are_told_apart(spark, monkeypatch, head):
    """Words that make up less than 1/512 of the tokens, each followed by another word of its own."""
    split(monkeypatch, head, 3)
    draw, texts = random.Random(1), []
    for k in range(300):
        words = [f"w{int(draw.paretovariate(0.6)) % 3000}" for _ in range(20)]
        texts.append(" ".join([*words[:10], f"key{k % 50}", f"lock{k % 50}", *words[10:]]))
    model = trained(spark, texts)
    assert 6 * 512 < model.n
    got = scores(spark, model, [f"key{a} lock{b}" for a in (1, 2, 3) for b in (1, 2, 3)])
    for a in (1, 2, 3):
        for b in {1, 2, 3} - {a}:
            assert got[f"key{a} lock{a}"].score > got[f"key{a} lock{b}"].score + 1


def plain(texts, queries, d, d1, sweeps=220, burn=20):
    """Scores by a loop over customers with explicit tables, a restaurant for every word."""
    draw = random.Random(2)
    tokens = lambda t: list(zip(["<s>", *t.split()], [*t.split(), "\n"], strict=True))
    pairs = [x for t in texts for x in tokens(t)]
    known, seats, roots = len({b for _, b in pairs}), {}, {}
    filled, sums = {}, {"c": 0, "t": 0}  # tables of a restaurant; customers and tables of the parent

    def parent(w):
        own = roots.get(w, [])
        return (sum(own) - d1 * len(own) + (1 + d1 * sums["t"]) / (known + 1)) / (1 + sums["c"])

    def sit(tables, new, disc):
        k = draw.choices(range(len(tables) + 1), [x - disc for x in tables] + [new])[0]
        tables[k:] = [1] if k == len(tables) else [tables[k] + 1, *tables[k + 1 :]]
        return len(tables) > 0 and k == len(tables) - 1 and tables[k] == 1

    def leave(tables):
        k = draw.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def join(u, w):
        if sit(seats.setdefault((u, w), []), (1 + d * filled.get(u, 0)) * parent(w), d):
            filled[u] = filled.get(u, 0) + 1
            sums["t"] += sit(roots.setdefault(w, []), (1 + d1 * sums["t"]) / (known + 1), d1)
            sums["c"] += 1

    for a, b in pairs:
        join(a, b)
    customers = {}
    for a, _ in pairs:
        customers[a] = customers.get(a, 0) + 1
    total = {x: 0.0 for t in queries for x in tokens(t)}
    for sweep in range(sweeps):
        for a, b in pairs:
            if leave(seats[a, b]):
                filled[a] -= 1
                sums["c"] -= 1
                sums["t"] -= leave(roots[b])
            join(a, b)
        if sweep >= burn:
            for a, b in total:
                own = seats.get((a, b), [])
                total[a, b] += (sum(own) - d * len(own) + (1 + d * filled.get(a, 0)) * parent(b)) / (1 + customers.get(a, 0)) / (sweeps - burn)
    return {t: [math.log10(total[x]) for x in tokens(t)] for t in queries}


def test_buckets_like_a_plain_sampler(spark, monkeypatch):
    """Seen and unseen pairs of frequent, rare and unknown words, against explicit tables; any number of buckets."""
    draw, texts = random.Random(5), []
    for _ in range(150):
        words = ["a"]
        for _ in range(draw.randint(2, 8)):
            after = "abcdefghijklmnop"["abcdefghijklmnop".index(words[-1]) // 2 :][:4] if draw.random() < 0.6 else "aaaabbbcdefghijklmnop"
            words.append(draw.choice(after))
        texts.append(" ".join(words))
    queries = [*dict.fromkeys(texts)][:40] + [" ".join(draw.choice("abcdefghijklmnopxyz") for _ in range(5)) for _ in range(60)] + ["", "x", "x y z"]
    found = []
    for head, buckets in ((4096, 1), (12, 1), (12, 5)):
        split(monkeypatch, head, buckets)
        model = trained(spark, texts, sweeps=24, burn=6)
        found.append(scores(spark, model, queries))
    assert {t: r.score for t, r in found[1].items()} == pytest.approx({t: r.score for t, r in found[2].items()})
    want = plain(texts, queries, *model.discounts)
    for got in found:
        gaps = [abs(got[t].score - sum(x)) / len(x) for t, x in want.items()]
        assert np.mean(gaps) < 0.01
        assert max(gaps) < 0.1


def test_counts_of_rare_words_and_pairs(spark, monkeypatch):
    """Counts and base scores are those of the plain rule, however few words are frequent."""
    split(monkeypatch, 8, 4)
    draw = random.Random(3)
    rows = [(k, " ".join(f"v{int(draw.paretovariate(0.7)) % 500}" for _ in range(draw.randint(0, 30)))) for k in range(200)]
    df = spark.createDataFrame([*rows, (None, "v1 unheard V1")], "doc_id long, text string").withColumn("held_out", F.col("doc_id").isNull() | (F.col("doc_id") % 7 == 0))
    model, counts = lm.train(df), {}
    for k, t in rows:
        for w in [*t.split(), "\n"] if k % 7 else []:
            counts[w] = counts.get(w, 0) + 1
    assert (model.n, model.known) == (sum(counts.values()), len(counts))
    got = {r.key: r for r in lm.scored(df, model).collect()}
    assert len(got) == len(rows) + 1
    for k, t in [*rows, (None, "v1 unheard v1")]:
        own = [*t.split(), "\n"]
        assert (got[k].n_tokens, got[k].n_known) == (len(own), sum(w in counts for w in own))
        assert got[k].base == pytest.approx(sum(math.log10(counts.get(w, 0) + 0.1) for w in own))
    table = {r.h: r.c for r in model.words.collect()}
    assert table == {lm._hash(w.encode()): c for w, c in counts.items()}


def test_buckets_come_in_small_rows(spark):
    """However large a bucket, no row, page or row group holds much of it, so neither does the JVM at once."""
    draw = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in draw.integers(0, 20000, 100)) for _ in range(400)]
    model = trained(spark, texts, sweeps=1, burn=0)
    size, longest = model.buckets.where("what = 'bucket'").agg(F.sum(F.length("blob")), F.max(F.length("blob"))).first()
    assert model.parts == 1
    assert size > 3 * (1 << 17) >= 3 * longest
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in model.buckets.inputFiles()]
    assert max(m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)) <= 128
    assert sum(r.c for r in model.words.collect()) == model.n == 400 * 101


def test_pieces_are_put_together():
    """Contents of one and of many pieces, in any order; what goes with a row goes once."""
    rows = [lm._row(3, "texts", np.arange(100_000)), lm._row(3, "sums", None, 0, [1, 2]), lm._row(3, "asks", "b" * (1 << 17), 9), lm._row(3, "asks", b"", 8)]
    batches = list(lm._rows(rows, pa.array(["x", None])))
    table = pa.Table.from_batches(batches)
    assert table.num_rows > 9
    assert max(len(b) for b in table["blob"].to_pylist()) <= lm.PIECE
    assert [x for x in table["keys"].to_pylist() if x] == [["x", None]]
    assert [x for x in table["sums"].to_pylist() if x] == [[1, 2]]
    got = list(lm._contents(table.take(np.random.default_rng(1).permutation(table.num_rows))))
    assert [x[:2] for x in got] == [("asks", 8), ("asks", 9), ("sums", 0), ("texts", 0)]
    assert (got[0][2], got[1][2], got[2][2]) == (b"", "b" * (1 << 17), None)
    assert np.array_equal(got[3][2], np.arange(100_000))


def test_draws_are_binomial():
    rng = np.random.default_rng(8)
    for n, p in ((4, 0.2), (2, 0.6), (10, 0.15), (5, 0.9), (300, 0.01), (1, 0.3), (1000, 0.3), (60, 0.8), (5000, 0.99)):
        got = lm.drawn(np.full(400_000, n), np.full(400_000, p), rng.random(400_000))
        assert abs(got.mean() / (n * p) - 1) < 0.02
        assert abs(got.var() / (n * p * (1 - p)) - 1) < 0.02


def test_words_are_hashed_together():
    """Hashes of words of any length, taken from an array of bytes, are XXH64's."""
    draw = random.Random(6)
    words = [bytes(draw.randrange(33, 256) for _ in range(n)) for n in [*range(1, 70), 1000] * 3]
    size = np.array([len(w) for w in words])
    data = np.frombuffer(b" ".join(words) + bytes(8), np.uint8)
    assert lm._hashes(data, np.cumsum(size + 1) - size - 1, size).tolist() == [lm._hash(w) for w in words]


def test_rows_of_small_numbers_are_small():
    """Numbers of which few are large take little more than a byte each, and come back with their types."""
    draw = np.random.default_rng(2)
    few = draw.geometric(0.4, 50_000)
    few[::400] = 1 << 40
    content = {"few": few, "pairs": (draw.integers(0, 9, (5000, 4)), draw.integers(-3, 3, 900)), "names": draw.integers(-(1 << 62), 1 << 62, 100), "none": np.empty(0, np.int64), "real": draw.random(70), "types": [few.astype(np.uint32) % 7, "x", 3]}
    blob = lm._row(0, "state", content)["blob"]
    assert len(blob) < 2.5 * 50_000 + 30_000
    (_, _, got), = lm._contents(pa.Table.from_batches(lm._rows([lm._row(0, "state", content)])))
    flat = lambda x: [x["few"], *x["pairs"], x["names"], x["none"], x["real"], x["types"][0]]
    assert got["types"][1:] == ["x", 3]
    for a, b in zip(flat(got), flat(content), strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b)


def test_state_comes_back_as_it_was():
    state = {"word": np.array([0, 0, 2, 5]), "node": np.array([1, 1, 300]), "ctx": np.array([-1, 7, 4096, -1]), "u": np.array([1 << 60, 0, 0, -5]), "w": np.array([3, 70_000, 0]), "h": np.array([9]), "samples": []}
    got = lm._read_state(lm._kept_state(state))
    assert got.keys() == state.keys()
    assert all(np.array_equal(got[k], x) and np.asarray(got[k]).dtype == np.asarray(x).dtype for k, x in state.items())


def test_known_words_are_not_searched_for(monkeypatch):
    """A word met before is found by the last bits of its hash, also where another word stands there."""
    names = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 1000)
    alike = np.concatenate((names, names[:10] ^ (1 << 40)))  # ten words with the last bits of ten others
    seen, calls, search = lm.Seen({int(names[3]): 7}), [], np.searchsorted
    first = seen.places(np.tile(alike, 3))
    assert (seen.hashes[first] == np.tile(alike, 3)).all() and len(seen.hashes) == len(alike)
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **named: calls.append(np.size(v)) or search(a, v, *more, **named))
    again = seen.places(np.tile(alike, 3)[::-1])
    assert (again == first[::-1]).all() and sum(calls) <= 30
    assert [int(k) for k in np.flatnonzero(seen.found[0] >= 0)] == [int(first[3])]
    seen.clear()
    first = seen.places(alike)
    assert (seen.hashes[first] == alike).all()


def test_owners_of_a_group_ascend():
    """Buckets are sent their dishes in the order in which they look them up."""
    draw, places = np.random.default_rng(2), 300
    hashes, heads = np.sort(draw.integers(-(1 << 62), 1 << 62, places)), np.where(np.arange(places) % 9 == 0, np.arange(places) // 9, -1).astype(np.int32)
    at, before = draw.integers(0, places, 5000), draw.integers(-1, places, 5000)
    key, order = lm._sorted(lm._pair(at, before, places), 2 * places.bit_length())
    assert (key == lm._pair(at, before, places)[order]).all() and sorted(order.tolist()) == list(range(5000))
    order, group, owner, other, near = lm._dishes(key, hashes, heads, 99, 4)
    assert sorted(order.tolist()) == list(range(len(key))) and (np.diff(group) >= 0).all()
    bits = places.bit_length()
    for k, g, o, x, b in zip(order.tolist(), group.tolist(), owner.tolist(), other.tolist(), near.tolist(), strict=True):
        word, ctx = int(key[k] >> bits), int(key[k] & ((1 << bits) - 1)) - 1
        place = 99 if ctx < 0 else int(heads[ctx])
        want = (hashes[word], place, 0) if place >= 0 else (hashes[ctx], heads[word], 1) if heads[word] >= 0 else (hashes[word], hashes[ctx], 2)
        assert (o, x, g % 3, b) == (*want, ctx) and g // 3 == int(lm._part(np.array([o]), 4)[0])
    for _, _, s in lm._cut(group):
        assert (np.diff(owner[s]) >= 0).all()


def test_names_alike_but_for_their_last_bits():
    """Dishes are merged and found by whole names, though sorted by less."""
    base = np.array([-(1 << 62), 5 << 40, (5 << 40) + 1, (5 << 40) + 2, 1 << 61], np.int64)
    owner, other = np.repeat(np.array([-7, 11], np.int64), 10), np.tile(np.concatenate((base, base[::-1])), 2)
    got = lm._merged([(0, {2: (*lm._runs(owner), other, np.ones(20, np.int64))})], 2)
    assert [x.tolist() for x in got] == [[-7] * 5 + [11] * 5, base.tolist() * 2, [2] * 10]
    at, names = np.repeat(np.arange(3), 5), np.tile(base, 3)
    keys = lm._ranked(at, 3, names)
    assert (np.diff(keys) >= 0).all() and (np.diff(keys) == 0).any()
    assert lm._find_ranked(keys, names, keys, names).tolist() == list(range(15))
    absent, nobody = names + 3, np.full(15, -1)
    assert (lm._find_ranked(keys, names, lm._ranked(at, 3, absent), absent) == -1).all()
    assert (lm._find_ranked(keys, names, lm._ranked(nobody, 3, names), names) == -1).all()
    none = np.empty(0, np.int64)
    assert (lm._find_ranked(none, none, lm._ranked(nobody, 0, names), names) == -1).all()
