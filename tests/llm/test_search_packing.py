"""Ranked search and packing against brute force."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuswright.llm import packing, registry, search

from ..util import connect, same

SF = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [x.translate(LOWER) for x in TERM.findall(text or "")]


def plain_search(docs, items, k=10):
    own = [(d, Counter(plain_terms(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n_docs, length = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    wants = {}
    for i, t in items:
        wants.setdefault(i, set()).update(plain_terms(t))
    out = []
    for i, terms in wants.items():
        scored = []
        for d, c, n in own:
            m = 10 + 90 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(i, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


TEXTS = ["Red fox", "red red fox den", "RED É é x1", None, "", "...", "fox-den fox_den", "a b c d e f g red", "red fox", "long " * 5000 + "fox", "É", "e\x00f fox", "x1 x1 x1"]


def search_rows(spark, docs, items, **more):
    got = search.ranked(spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(items, "item_id long, text string, rank int"), **more)
    return sorted(map(tuple, got.collect()), key=repr)


def test_search_equals_brute_force(spark):
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(1, TEXTS[1]), (None, "red fox"), (None, "fox")]
    items = [(1, "the RED fox"), (2, "É x1"), (3, None), (4, "nothing here"), (5, "fox fox fox"), (None, "den"), (1, "den"), (6, "e f")]
    got = search_rows(spark, [(*d, 7) for d in docs], [(*i, 7) for i in items])
    assert got == plain_search(docs, items)
    assert search_rows(spark, [(*d, 7) for d in docs], [(*i, 7) for i in items], k=2) == plain_search(docs, items, 2)


def test_search_of_nothing(spark):
    assert search_rows(spark, [], [(1, "x", 1)]) == []
    assert search_rows(spark, [(1, "x", 1)], []) == []
    assert search_rows(spark, [(1, None, 1), (2, "", 1)], [(1, "x", 1)]) == []


def test_search_in_blocks_of_documents_and_items(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    draw = lambda n: " ".join(words[min(59, int(x))] for x in rng.exponential(9, n))
    docs = [(k, draw(int(rng.integers(1, 60)))) for k in range(600)] + [(k, draw(3)) for k in range(600, 700)] * 2
    items = [(k, draw(int(rng.integers(1, 25)))) for k in range(30)]
    want = plain_search(docs, items)
    monkeypatch.setattr(search, "POSTINGS", 900)
    monkeypatch.setattr(search, "ITEM_BYTES", 700)
    assert search_rows(spark, [(*d, 0) for d in docs], [(*i, 0) for i in items]) == want


def test_search_stops_before_the_end_of_its_lists():
    rng = np.random.default_rng(3)
    term = np.repeat([0, 1], 20_000)
    doc = np.concatenate([rng.permutation(20_000), rng.permutation(20_000)]).astype(np.int32)
    impact = np.where(rng.random(40_000) < 0.002, 900_000, 1000) + rng.integers(0, 50, 40_000)
    index = search.Index(term, doc, impact, 20_000)
    docs, scores, read = index.best([0, 1], 10)
    whole = np.zeros(20_000, np.int64)
    np.add.at(whole, doc, impact)
    order = np.lexsort((np.arange(20_000), -whole))[:10]
    got = sorted(zip((-scores).tolist(), docs.tolist(), strict=True))[:10]
    assert [d for _, d in got] == order.tolist()
    assert [-s for s, _ in got] == whole[order].tolist()
    assert read < 1000
    assert not index.total.any()


def test_search_equals_sql(spark):
    same(registry.queries()["op12_ranked_search"](spark, SF), connect(SF), registry.oracle_sql()["op12_ranked_search"])


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


ODD = [
    "a\n\nb", "a\n\n\nb", "a \nb", "a\n b", "a  b", " a", "a ", "\na", "a\n", "a\n\n", "\n", " ", "  ", "\n\n", "a\r\nb", "a\tb c", "\0a", "a \0b", "a\n\0b", "é x y", "x　 y", "it's 2024's\nit's", "x<|endoftext|> y", "x\n\n<|endoftext|>\n\ny",
    "<|endoftext|>", "x <|endoftext|>\n", "\x1c a \x1d b", "a\x85b c", "１２ ３４\n五", "", "a b c", "a\n\nb\n\nc d", "\n\na", "a\n\n b", "naïve ퟿ x", "a\n\n\n", "ab\nab ab\n\nab",
]


def test_stretches_give_the_ids_of_whole_texts(tokenizer):
    own = packing.Encoder(TOKENIZER)
    for texts in (ODD, [x + y for x in ODD for y in ODD]):
        for text, ids in zip(texts, own.encoded(texts), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\0abcé'1.<|> 　\r", max_size=40))
def test_any_text_has_its_ids(text):
    own = packing.encoder(TOKENIZER)
    assert own.encoded([text])[0].tolist() == own.own.encode(text, add_special_tokens=False).ids


def packed(spark, docs, **more):
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int").repartition(3)
    return packing.pieces(frame, **more)


def test_pieces_are_gapless_and_whole(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 50)
    docs = list(enumerate([None, *ODD, "word " * 5000, "x" * 3000])) + [(3, "a b"), (3, "a b"), (None, "c"), (None, None)]
    rows = [r.asDict() for r in packed(spark, docs).collect()]
    want = sorted((repr(k), tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for k, t in docs)
    by_place = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    whole, found = [], []
    for r in by_place:  # no hole in the stream, no sequence over its width
        assert r["sequence_id"] * 1024 + r["offset"] == at
        assert r["length"] == len(r["ids"]) // 4 > 0
        assert r["offset"] + r["length"] <= 1024
        at += r["length"]
        whole += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == len(whole) - r["length"] if not whole or r["start"] == 0 and not found else True
        if r["start"] == 0:
            found.append((repr(r["key"]), []))
        assert r["start"] == len(found[-1][1]) and found[-1][0] == repr(r["key"])
        found[-1][1].extend(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
        assert (len(found[-1][1]) == r["n"]) == (r["start"] + r["length"] == r["n"])
    assert sorted((k, tuple(x)) for k, x in found) == want
    assert all(sum(r["length"] for r in rows if r["sequence_id"] == s) == 1024 for s in range(at // 1024))


def test_sequences_are_put_together(spark):
    own = packed(spark, [(k, "one two three " * (k % 40)) for k in range(200)], width=64)
    rows = {r.sequence_id: r for r in packing.sequences(own).collect()}
    stream = [r for r in sorted(own.collect(), key=lambda r: (r.sequence_id, r.offset))]
    assert b"".join(bytes(rows[k].ids) for k in sorted(rows)) == b"".join(bytes(r.ids) for r in stream)
    assert all(r.n == 64 and len(r.ids) == 256 for k, r in rows.items() if k < max(rows))
    assert all(r.offsets[0] == 0 and len(r.keys) == len(r.offsets) for r in rows.values())


def test_packing_query(spark):
    rows = registry.queries()["op13_packing"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own = packing.encoder(TOKENIZER).own
    ids = {d: np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_packing_of_nothing(spark):
    assert packed(spark, []).count() == 0
