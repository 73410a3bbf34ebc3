"""The automaton against ``str.count``."""

from __future__ import annotations

import random

import pytest

from corpuswright.operators import patterns


def plain(texts, words):
    return sorted((k, w, t.count(w)) for k, t in texts for w in words if t and t.count(w))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefg ", "あいう設計x"])
def test_counts_are_those_of_str(alphabet):
    rng = random.Random(len(alphabet))
    draw = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    words = sorted({draw(rng.randrange(1, 7)) for _ in range(60)} | {"aa", "aba", alphabet * 3})
    texts = [draw(rng.randrange(0, 900)) for _ in range(80)] + ["", alphabet * 300, "zzz", "a" * 700]
    one = patterns.Automaton(words)
    got = sorted((int(k), words[w], int(n)) for k, w, n in zip(*one.counts(texts), strict=True))
    assert got == plain(list(enumerate(texts)), words)


def test_many_automata_and_blocks(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 6))) for _ in range(500)]
    texts = [(k, "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(0, 700)))) for k in range(60)] + [(60, None), (None, "abab"), (3, "aabb")]
    monkeypatch.setattr(patterns, "CELLS", 3000)
    assert len(patterns.automata(sorted(set(words)))) > 1
    monkeypatch.setattr(patterns, "WORD_BYTES", 700)
    lexicon = spark.createDataFrame([(w,) for w in [*words, "", None]], "word string")
    got = patterns.occurrences(spark.createDataFrame(texts, "id int, body string").repartition(3), "id", "body", lexicon).collect()
    assert sorted((r.key if r.key is not None else -1, r.word, r.n) for r in got) == plain([(k if k is not None else -1, t) for k, t in texts], set(words))


def test_words_in_no_text_count_nothing(spark):
    lexicon = spark.createDataFrame([("ab",), ("zz",), ("ab",)], "word string")
    rows = {tuple(r) for r in patterns.word_counts(spark.createDataFrame([(1, "abab"), (2, "xab")], "id int, t string"), "id", "t", lexicon).collect()}
    assert rows == {("ab", 2, 3), ("zz", 0, 0)}
    assert patterns.word_counts(spark.createDataFrame([], "id int, t string"), "id", "t", lexicon).count() == 2
    assert patterns.occurrences(spark.createDataFrame([(1, "x")], "id int, t string"), "id", "t", lexicon.limit(0)).count() == 0
