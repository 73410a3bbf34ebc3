"""SimHash, audio, the language model, and the pipeline."""

from __future__ import annotations

import io
import math
import random
import wave
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpuswright.llm import audio, lm, quality, simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def roots(values, near):
    at = list(range(len(values)))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                at[find(i)] = find(j)
    return [find(k) for k in range(len(values))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "A b", "a B c d É", "x y z " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_pigeonring_loses_no_link(spark, monkeypatch):
    """Fingerprints in dense clusters, with buckets of several tiles, against all pairs."""
    monkeypatch.setattr(simhash, "TILE", 16)
    draw = random.Random(5)
    values = set()
    for _ in range(40):
        centre = draw.getrandbits(64)
        for _ in range(12):
            x = centre
            for _ in range(draw.randint(0, 4)):
                x ^= 1 << draw.randint(0, 63)
            values.add(x)
    centre = draw.getrandbits(64)
    values |= {centre ^ sum(1 << b for b in draw.sample(range(8), 3)) for _ in range(200)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = roots(values, lambda a, b: (a ^ b).bit_count() <= 3)
    mine = [got.get(s, s) for s in signed]
    assert len({(a, b) for a, b in zip(want, mine, strict=True)}) == len(set(want)) == len(set(mine))


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert set(got.values()) == {0, 500}
    assert len(got) == 203
    assert simhash.components(df.where("false")).count() == 0


def test_near_duplicates_edges(spark):
    base = " ".join(f"w{k}" for k in range(300))
    rows = [(7, base), (3, base), (9, base.upper()), (1, None), (2, ""), (None, base), (4, "other words entirely here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.op8(df).collect()}
    assert {got[k].component_id for k in (7, 3, 9, None)} == {3}
    assert got[1].component_id == got[2].component_id == 1
    assert got[1].fingerprint == "0" * 16
    assert simhash.op8(df.where("false")).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_one(df.union(df)).collect()) == [1, 3, 4]


def tone(notes):
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * np.arange(320) / 2000) for k in notes])


def test_keep_one_keeps_other_groups(spark):
    rows = [(None, "one text of its own here"), (None, "quite another text it is"), (None, "quite another text it is"), (7, "a third thing said of seven"), (7, "fourth words under one id"), (1, "one text of its own here"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text or "") for r in simhash.keep_one(df).collect()]
    assert sorted(got, key=str) == sorted([(1, rows[0][1]), (None, rows[1][1]), (7, rows[3][1]), (7, rows[4][1]), (None, "")], key=str)


def test_audio_aligns_a_cut(spark):
    draw = random.Random(1)
    notes = [draw.randint(0, 11) for _ in range(64)]
    whole, cut = audio.integers(audio.chroma(tone(notes), 2000)), audio.integers(audio.chroma(tone(notes[10:]), 2000))
    shift = 20  # ten notes of two hops
    n = min(len(whole) - shift, len(cut))
    assert np.bitwise_count(whole[shift : shift + n] ^ cut[:n]).mean() / 32 < 0.05


def best_errors(a, b):
    """Least share of differing bits over all offsets with enough overlap."""
    least = audio.LEAST_FRAMES
    found = [np.bitwise_count(x[:n] ^ y[:n]).mean() / 32 for o in range(least - len(a), len(b) - least + 1) for x, y in [(a[max(0, -o) :], b[max(0, o) :])] if (n := min(len(x), len(y))) >= least]
    return min(found, default=1.0)


def recall(got, codes, members, queries):
    pairs = {(r.query_class, r.match_class) for r in got}
    want = {(members[q], members[k]) for q in queries for k in members if members[q] != members[k] and best_errors(codes[q], codes[k]) <= audio.MOST_ERRORS}
    assert pairs <= want  # nothing is reported that a look at all offsets doesn't confirm
    assert len(want) >= 20
    return len(pairs & want) / len(want)


def heard(df):
    return {r.key: np.array(r.codes, np.int32).view(np.uint32) for r in audio.fingerprints(df, "key", "audio").collect()}


@pytest.mark.parametrize("noise", [0.01, 0.02, 0.03, 0.04])
def test_audio_recall_against_all_offsets(spark, noise):
    draw = np.random.default_rng(2)
    base = draw.normal(0, 0.125, (8, 64))
    vectors = [(k, (base[k % 8] + draw.normal(0, noise, 64)).tolist()) for k in range(160)] + [(900, None), (901, []), (950, None)]
    tunes = audio.tune(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    members, pairs = audio.aligned(tunes, "key", "audio", F.col("key") % 20 == 0)
    members = {r.key: r.class_id for r in members.collect()}
    assert len(members) == 163
    assert members[901] == members[950] == 900
    assert recall(pairs.collect(), heard(tunes), members, range(0, 160, 20)) >= 0.9


def wav(values, rate=2000, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(width)
        file.setframerate(rate)
        file.writeframes((np.clip(values, -1.3, 1.3) * 24_000).astype("<i2").tobytes())
    return out.getvalue()


def test_audio_recall_of_cuts(spark, monkeypatch):
    """Recordings with light noise, cut at places that are no multiple of a hop; hot anchors in several tiles."""
    monkeypatch.setattr(audio, "TILE", 4)
    draw = np.random.default_rng(3)
    whole = [tone(draw.integers(0, 12, 64)) * 0.6 for _ in range(20)] + [np.zeros(20480), np.zeros(20481)]
    rows = [(k, bytearray(wav(x))) for k, x in enumerate(whole)]
    for k in range(60):
        x = whole[k % 20][draw.integers(0, 4500) :]
        rows.append((100 + k, bytearray(wav(x + draw.normal(0, 0.02, len(x))))))
    df = spark.createDataFrame(rows, "key long, audio binary")
    members, pairs = audio.aligned(df, "key", "audio", F.col("key") < 100)
    assert recall(pairs.collect(), heard(df), {r.key: r.class_id for r in members.collect()}, range(20)) >= 0.9


def test_audio_edges(spark):
    good = wav(tone([1, 5, 9, 2] * 16))
    broken = [b"", b"RIFF", good[:30], good[:24] + bytes(4) + good[28:], good[:34] + b"\x28\x00" + good[36:], wav(np.zeros(50))]
    rows = [(k, bytearray(x), "x", 1) for k, x in enumerate(broken)] + [(10, bytearray(good), None, 2), (None, bytearray(good), "y", 3), (11, None, None, None), (12, bytearray(wav(np.tile(tone([1, 5, 9, 2]), 400))), "long", 4)]
    df = spark.createDataFrame(rows, "key long, audio binary, codes string, q int")
    members, pairs = audio.aligned(df, "key", "audio", F.lit(True))
    got = {r.key: r for r in members.collect()}
    assert {got[k].n_codes for k in (*range(6), 11)} == {0}
    assert {got[k].class_id for k in (*range(6), 11)} == {0}
    assert got[None].class_id == 10
    assert {(r.query_class, r.match_class) for r in pairs.collect()} == {(10, 12), (12, 10)}
    assert audio.op5(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def corpus(spark, n=400):
    """Texts like language: few words are frequent, very many rare, and what follows depends on what was before."""
    draw, rows = random.Random(4), []
    for k in range(n):
        words = []
        for _ in range(draw.randint(0, 60)):
            follows = words and draw.random() < 0.5 and len(words[-1]) < 4
            words.append(f"after{words[-1]}" if follows else f"w{int(draw.paretovariate(0.7)) % 100_000}")
        rows.append((k, " ".join(words)))
    return rows + [(None, None), (None, "W1 w1")], "doc_id long, text string"


def test_model_counts_and_base(spark):
    rows, shape = corpus(spark)
    got = lm.op10(spark.createDataFrame(rows, shape)).collect()
    assert len(got) == len(rows)
    counts, tokens = {}, lambda t: [*(t or "").encode().lower().split(), b"\n"]
    for k, t in rows:
        if k is not None and zlib.crc32(str(k).encode()) % 10:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, known = sum(counts.values()), len(counts)
    texts = dict(rows[:-2])
    for r in got:
        if r.doc_id is None:
            assert r.held_out
            continue
        own = tokens(texts[r.doc_id])
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (known + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_of_the_model(spark, monkeypatch):
    """Tokens as the plain rule has them, also where the words met are forgotten between stretches."""
    texts = [" lead  two\x0bwords\x0c\r\n ", "", None, "\x1c\x1f no blanks\xa0here \u3000", "ÀÉ Az İ", "\t", "x " * 50, "same same"] * 3
    plain = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    monkeypatch.setattr(lm, "GROUP", 40)
    monkeypatch.setattr(lm, "FLUSH", 3)
    monkeypatch.setattr(lm, "PAIRS", 20)
    batch, seen, got = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), lm.Seen(), []
    for _, at, counts in lm._grouped(iter([batch]), 0, seen):
        words = {k: w for w, k in seen.index.items()}
        ends = np.cumsum(counts)
        got += [[words[k] for k in at[a:b].tolist()] for a, b in zip(ends - counts, ends, strict=True)]
    assert got == plain
    df = spark.createDataFrame([(t, False) for t in texts], "text string, held_out boolean").coalesce(1)
    counts = Counter(w for row in plain for w in row)
    assert {r.h: r.c for r in lm._occurrences(df).collect()} == {lm._hash(w): c for w, c in counts.items()}
    pairs = Counter((lm._hash(b), 2 if a is None else int(a == b"same") or 3) for row in plain for a, b in zip([None, *row], row, strict=False))
    assert {(r.h, r.ctx): r.c for r in lm._pairs(df, {lm._hash(b"none"): 0, lm._hash(b"same"): 1}).collect()} == pairs


def test_model_is_a_distribution(spark):
    """In every context the probabilities of all known tokens and the unknown one sum to 1."""
    rows, shape = corpus(spark, 200)
    df = spark.createDataFrame(rows, shape).withColumn("held_out", F.lit(False))
    model = lm.train(df)
    table = model.words.collect()
    n = len(model.backoffs)
    for ctx in (0, 1, len(model.contexts), len(model.contexts) + 1):
        total = sum(u * b[ctx] for u, b in zip(model.unknown, model.backoffs, strict=True)) / n
        for r in table:
            total += r.probs[r.ctxs.index(ctx)] / n if ctx in r.ctxs else sum(p * b[ctx] for p, b in zip(r.p1, model.backoffs, strict=True)) / n
        assert total == pytest.approx(1)


def stirling(c, t, d):
    if c == 0 or t == 0:
        return float(c == t)
    return stirling(c - 1, t - 1, d) + max(c - 1 - d * t, 0) * stirling(c - 1, t, d) if t <= c else 0.0


def test_reseating_has_the_posterior():
    """A word's tables in two restaurants and in the parent, by sweeps of many replicas, against all seatings."""
    cs, others, (rest_c, rest_t), known, (d, d1) = np.array([3, 2]), np.array([4.0, 7.0]), (9.0, 6.0), 5, (0.4, 0.6)
    law = {}
    for a in range(1, 4):
        for b in range(1, 3):
            for t1 in range(1, a + b + 1):
                p = stirling(a + b, t1, d1) * math.prod(1 + d1 * (rest_t + k) for k in range(t1)) * (known + 1.0) ** -t1 / math.prod(1 + rest_c + k for k in range(a + b))
                for t, c, o in ((a, 3, 4.0), (b, 2, 7.0)):
                    p *= stirling(c, t, d) * math.prod(1 + d * (o + k) for k in range(t))
                law[a, b, t1] = p
    whole, n = sum(law.values()), 20_000
    word, t1 = np.repeat(np.arange(n), 2), np.ones(n, np.int64)
    ts = np.ones(2 * n, np.int64)
    for step in range(25):
        seed = lm.splitmix(np.arange(2 * n, dtype=np.uint64) + np.uint64(step * 1_000_003))
        # the totals of other words stay as they are, whatever a replica does
        own = np.bincount(word, ts, n)
        ts, t1 = lm.reseated(word, np.tile(cs, n), ts, t1, np.tile(others, n), (rest_c + own, rest_t + t1), known, (d, d1), seed)
    seen = Counter(zip(ts[::2].tolist(), ts[1::2].tolist(), t1.tolist(), strict=True))
    assert set(seen) <= set(law)
    for state, p in law.items():
        p /= whole
        assert abs(seen[state] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 4e-3, state


@pytest.mark.parametrize("customers", [60, 200])
def test_large_dishes_move_like_small_ones(monkeypatch, customers):
    """Tables of a dish whose customers move in groups against one at a time."""
    n, d, means = 1500, 0.5, []
    for steps, sweeps in ((lm.STEPS, 30), (customers, 12)):
        monkeypatch.setattr(lm, "STEPS", steps)
        ts = lm.first_tables(np.full(n, customers), np.full(n, 0.2), d, np.random.default_rng(1).random(n))
        t1, seen = np.ones(n, np.int64), []
        for step in range(sweeps):
            seed = lm.splitmix(np.arange(n, dtype=np.uint64) + np.uint64(step << 20))
            ts, t1 = lm.reseated(np.arange(n), np.full(n, customers), ts, t1, np.full(n, 20.0), (40.0 + ts, 30.0 + t1), 50, (d, 0.6), seed)
            seen.append((ts.mean(), t1.mean()))
        means.append(np.mean(seen[sweeps // 2 :], axis=0))
    assert np.allclose(*means, rtol=0.06)


def test_scaled_chance_to_sit_alone():
    """Beyond the table the share of tables with one customer is that of a dish with as many in proportion."""
    exact = lm.alone(np.array([300] * 3), np.array([5, 20, 60]), 0.5)
    scaled = lm.alone(np.array([3000] * 3), np.array([14, 61, 188]), 0.5)
    assert np.allclose(scaled * 3000 / [14, 61, 188], exact * 300 / [5, 20, 60], rtol=0.05)
    table = lm.alone_table(0.5)
    assert table[2, 2] == table[7, 7] == 1
    assert table[5, 1] == 0


def test_model_like_a_plain_sampler(spark):
    """Averaged predictions of a small corpus against a plain loop over customers with explicit tables."""
    draw = random.Random(2)
    texts = [" ".join(draw.choice("aaabbcd") if draw.random() < 0.8 else draw.choice("efgh") for _ in range(draw.randint(3, 12))) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("held_out", F.lit(False))
    model = lm.train(df, sweeps=30, burn=6)
    _, d, d1 = 1.0, model.discounts[0], model.discounts[1]
    start = "<s>"
    pairs = [(a, b) for t in texts for a, b in zip([start, *t.split()], [*t.split(), "\n"], strict=True)]
    words = sorted({b for _, b in pairs})
    known, seats, roots = len(words), {}, {}
    rows = {r.h: r for r in model.words.collect()}
    contexts = {u: model.contexts.get(lm._hash(u.encode()), len(model.contexts) + 1) for u in {a for a, _ in pairs} - {start}} | {start: len(model.contexts)}

    def parent_prob(w):
        own, c, t = roots.get(w, []), sum(map(sum, roots.values())), sum(map(len, roots.values()))
        return (max(sum(own) - d1 * len(own), 0) + (1 + d1 * t) / (known + 1)) / (1 + c)

    def leave(tables):
        k = draw.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def sit(tables, new, disc):
        k = draw.choices(range(len(tables) + 1), [x - disc for x in tables] + [new])[0]
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def join(u, w):
        here = seats.setdefault(u, {})
        t = sum(map(len, here.values()))
        if sit(here.setdefault(w, []), (1 + d * t) * parent_prob(w), d):
            sit(roots.setdefault(w, []), (1 + d1 * sum(map(len, roots.values()))) / (known + 1), d1)

    for a, b in pairs:
        join(contexts[a], b)
    total, n = {}, 0
    for sweep in range(60):
        for a, b in pairs:
            if leave(seats[contexts[a]][b]):
                leave(roots[b])
            join(contexts[a], b)
        if sweep >= 10:
            n += 1
            for u, here in seats.items():
                c, t = sum(map(sum, here.values())), sum(map(len, here.values()))
                for w in words:
                    own = here.get(w, [])
                    total[u, w] = total.get((u, w), 0) + (max(sum(own) - d * len(own), 0) + (1 + d * t) * parent_prob(w)) / (1 + c)
    gaps = []
    for (u, w), x in total.items():
        r, samples = rows[lm._hash(w.encode())], len(model.backoffs)
        mine = r.probs[r.ctxs.index(u)] / samples if u in r.ctxs else sum(p * b[u] for p, b in zip(r.p1, model.backoffs, strict=True)) / samples
        gaps.append(abs(math.log(mine / (x / n))))
    assert np.mean(gaps) < 0.05
    assert max(gaps) < 0.3


def test_model_without_training_tokens(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = lm.op10(df).collect()
    assert [(r.score, r.base_score) for r in got] == [(0.0, 0.0)] * 2
    assert lm.op10(df.where("false")).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_texts_against_all_pairs(spark, monkeypatch):
    """Texts that share 0.8 of their shingles or more meet, those that share less than 0.6 don't; hot bands in tiles."""
    monkeypatch.setattr(simhash, "TILE", 16)
    draw, texts = random.Random(6), []
    for _ in range(40):
        words = [f"w{draw.randint(0, 5000)}" for _ in range(draw.choice([40, 120, 400]))]
        texts.append(words)
        for _ in range(draw.choice([1, 2, 12])):
            near = list(words)
            for _ in range(draw.randint(1, max(1, len(words) // 30))):
                near[draw.randrange(len(near))] = f"x{draw.randint(0, 5000)}"
            texts.append(near)
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string")
    got = {r.key: r.component for r in simhash.similar(df).collect()}
    sets = [shingles(" ".join(x)) for x in texts]
    pairs = [(i, j, jaccard(sets[i], sets[j])) for i in range(len(sets)) for j in range(i)]
    near = [got[i] == got[j] for i, j, x in pairs if x >= 0.8]
    assert len(near) > 100
    assert sum(near) >= 0.97 * len(near)
    for k in range(len(sets)):
        if got[k] != k:
            assert max(jaccard(sets[k], sets[j]) for j in range(len(sets)) if j != k and got[j] == got[k]) >= 0.6


def test_ring_of_wide_fingerprints():
    """The chain of budgets passes every pair within the radius and no other."""
    draw = np.random.default_rng(4)
    x = draw.integers(0, 1 << 63, (400, 4), np.uint64)
    turned = np.zeros((400, 256), np.uint8)
    for k in range(400):
        turned[k, draw.choice(256, draw.integers(0, 90), replace=False)] = 1
    y = x ^ np.packbits(turned, axis=1).view(np.uint64)
    assert (simhash._linked_wide(x, y, 0) == (turned.sum(axis=1) <= simhash.WIDE_BITS)).all()


def test_pipeline_stage_edges(spark):
    """Nulls, shared ids, extra and clashing columns, an empty table: every stage returns what its docstring says."""
    text = " ".join(f"word{k}" for k in range(80))
    other = " ".join(f"name{k}" for k in range(80))
    rows = [(None, text, "en", None, 5, 1, {"a": 1}), (None, other, "en", "s", 5, 2, None), (None, None, None, "s", None, 3, None), (7, text + " more", "en", "s", 5, 4, {"a": 1}), (7, other.upper(), "en", "t", 5, 5, None), (8, "", "en", "t", 0, 6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _cw_n int, component map<string,int>")
    one = corpus_pipeline.quality_stage(spark, df, "")
    assert sorted(r._cw_n for r in one.collect()) == [1, 2, 4, 5]
    clash = df.withColumnsRenamed({"_cw_n": "n_words", "n_chars": "kept", "component": "row"})
    got = corpus_pipeline.quality_stage(spark, clash, "")
    assert got.columns == clash.columns
    assert sorted(r.n_words for r in got.collect()) == [1, 2, 4, 5]
    two = corpus_pipeline.dedup_stage(spark, one, "")
    assert two.columns == df.columns
    assert sorted(r._cw_n for r in two.collect()) == [4, 5]  # of both groups the row with a key
    assert sorted(r._cw_n for r in corpus_pipeline.dedup_stage(spark, df, "").collect()) == [4, 5, 6]
    three = corpus_pipeline.mixing_stage(spark, two, "")
    assert three.columns == df.columns
    four = corpus_pipeline.encoding_stage(spark, df, "")
    assert four.count() == 6
    assert four.where("not lossless").count() == 0
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.dedup_stage, corpus_pipeline.mixing_stage, corpus_pipeline.encoding_stage):
        assert stage(spark, df.where("false"), "").count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.op9(docs).where("kept").collect()}
    one = corpus_pipeline.quality_stage(spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == kept
    assert one.columns == docs.columns
    two = corpus_pipeline.dedup_stage(spark, one, sf)
    assert two.columns == docs.columns
    groups = {r.doc_id for r in two.collect()}
    rows = sorted((r.doc_id, shingles(r.text)) for r in one.collect())
    near = {k: max((jaccard(a, b) for j, b in rows if j != k), default=0) for k, a in rows}
    assert groups >= {k for k in kept if near[k] < 0.6}
    gone = kept - groups
    late = {k for k, a in rows if any(j < k and jaccard(a, b) >= 0.8 for j, b in rows)}  # brute force: copies of an earlier text
    assert len(late) >= 10
    assert len(gone & late) >= 0.95 * len(late)
    three = corpus_pipeline.mixing_stage(spark, two, sf)
    assert three.columns == docs.columns
    assert {r.doc_id for r in three.collect()} <= groups
    four = corpus_pipeline.encoding_stage(spark, three, sf)
    assert four.count() == three.count() == corpus_pipeline.run(spark, sf).count()
    assert four.where("not lossless").count() == 0


def test_clashing_columns_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 100)
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    rows = [(1, long, "a", 1, 0.5), (2, long + " end", "b", None, None), (3, None, None, 3, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int, score double")
    got = {r.doc_id: r for r in simhash.op8(df).collect()}
    assert int(got[1].fingerprint, 16) == plain_fingerprint(long)
    assert got[2].component_id == 1
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    scores = {r.doc_id: r for r in lm.op10(df).collect()}
    assert (scores[2].n_tokens, scores[3].n_tokens) == (200_002, 1)
    assert all(r.score < 0 for r in scores.values())


def test_stages_keep_odd_columns_and_long_texts(spark):
    rng = np.random.default_rng(4)
    long = " ".join(f"w{x}" for x in rng.integers(0, 5000, 60_000))
    rows = [(k, long if k == 3 else " ".join(f"v{x}" for x in rng.integers(0, 900, 80)), "s", k, k, "z", k) for k in range(12)] + [(3, long, "s", 3, 3, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, key int, mark string, copies int")
    kept = corpus_pipeline.dedup_stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.n, r.key, r.mark, r.copies) for r in kept.collect()) == [(k, k, k, "z", k) for k in range(12)]
    mixed = corpus_pipeline.mixing_stage(spark, df, "")
    assert mixed.columns == df.columns
    assert {(r.doc_id, r.n) for r in mixed.collect()} == {(k, k) for k in range(12)}
    coded = corpus_pipeline.encoding_stage(spark, df, "")
    assert coded.where("lossless").count() == 13
