"""Edit-aware token counts.

A document's pre-tokens are kept as the leaves of a segment tree whose nodes hold sums of characters and of tokens. An
edit finds its place by descending the character sums, re-encodes only from the last safe cut before it to the first
safe cut after it, puts the new pre-tokens into the touched leaves and renews the sums on their paths to the root. A
safe cut is a single space between two characters that are no white space: the pattern always starts a pre-token
there, and looks neither back beyond nor ahead across it.

The same cuts split whole texts, so what lies between two cuts (a chunk) is encoded once and its counts are looked up
for its next use.

Defined results: a null text is empty and has no tokens; places of an edit are code points, are cut to the text's
length, and a stop before its start means start; null edits or a null insertion change or insert nothing; equal rows
get equal results; an empty table gives an empty result; only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, by_size, spare, vocabulary

RANKS = "byte_bpe_50k.tiktoken"
#: The public pattern that belongs to this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S) (?=\S)")
LEAF = 32  # pre-tokens of a leaf when a tree is built
KEPT = 150_000  # chunks whose counts a worker keeps


class Counter:
    """Counts tokens of pre-tokens, over the chunks it has met."""

    def __init__(self, ranks: str = f"{TOKENIZERS}/{RANKS}", pattern: str = PATTERN) -> None:
        import regex
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.pretokens = regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.first, self.many = np.empty(0, np.int64), np.empty(0, np.int64)
        self.chars, self.tokens = np.empty(0, np.int32), np.empty(0, np.int32)

    def counted(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each pre-token of a text."""
        found = self.pretokens(text)
        encode = self.encoding.encode_ordinary
        return [len(x) for x in found], [len(encode(x)) for x in found]

    def _learn(self, chunks: list[str]) -> None:
        chars: list[int] = []
        tokens: list[int] = []
        many = []
        for chunk in chunks:
            self.place[chunk] = len(self.place)
            a, b = self.counted(chunk)
            many.append(len(a))
            chars += a
            tokens += b
        ends = np.cumsum(np.array(many, np.int64))
        self.first = np.concatenate((self.first, len(self.chars) + ends - many))
        self.many = np.concatenate((self.many, np.array(many, np.int64)))
        self.chars = np.concatenate((self.chars, np.array(chars, np.int32)))
        self.tokens = np.concatenate((self.tokens, np.array(tokens, np.int32)))

    def leaves(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Characters and tokens of the pre-tokens of each text."""
        if len(self.place) > KEPT:
            self._clear()
        chunks, counts = [], []
        for text in texts:
            own = CUT.split(text) if text else []
            counts.append(len(own))
            chunks += own[:1]
            chunks += [" " + x for x in own[1:]]
        place = self.place
        if new := [c for c in dict.fromkeys(chunks) if c not in place]:
            self._learn(new)
        at = np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))
        many = self.many[at]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        flat = np.arange(total) + np.repeat(self.first[at] - (ends - many), many)
        chars, tokens = self.chars[flat], self.tokens[flat]
        out, chunk, begin = [], 0, 0
        for n in counts:
            chunk += n
            end = int(ends[chunk - 1]) if chunk else 0
            out.append((chars[begin:end], tokens[begin:end]))
            begin = end
        return out


class Tree:
    """The segment tree of one document: node k has children 2k and 2k + 1, leaves stand from ``half`` on."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, counter: Counter) -> None:
        self.text, self.counter, self.encoded, self.renewed = text, counter, 0, 0
        at = np.arange(0, len(chars), LEAF)
        n = max(1, len(at))
        self.half = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.half), np.int64)  # of characters, of tokens
        if len(at):
            self.sums[0, self.half : self.half + n] = np.add.reduceat(chars, at)
            self.sums[1, self.half : self.half + n] = np.add.reduceat(tokens, at)
        level = self.half
        while level > 1:
            below = self.sums[:, level : 2 * level]
            self.sums[:, level // 2 : level] = below[:, ::2] + below[:, 1::2]
            level //= 2
        self.chars, self.tokens, self.changed = chars, tokens, {}

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def _leaf(self, k: int) -> tuple[list[int], list[int]]:
        if k in self.changed:
            return self.changed[k]
        own = slice(k * LEAF, (k + 1) * LEAF)
        return self.chars[own].tolist(), self.tokens[own].tolist()

    def pretokens(self) -> int:
        n = -(-len(self.chars) // LEAF)
        return len(self.chars) + sum(len(a) - len(self.chars[k * LEAF : (k + 1) * LEAF]) for k, (a, _) in self.changed.items() if k < max(n, 1))

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds this character, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.half:
            node *= 2
            left = int(self.sums[0, node])
            if place >= before + left and self.sums[0, node + 1]:
                before, node = before + left, node + 1
        return node - self.half, before

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Replaces the characters from start to stop."""
        size = len(self.text)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        text = self.text[:start] + insert + self.text[stop:]
        # the last cut all of whose three characters stand before the edit, and the first of those after it
        low = start
        while True:
            low = self.text.rfind(" ", 1, max(low - 1, 1))
            if low < 1:
                low = 0
                break
            if CUT.match(self.text, low):
                break
            low += 1
        high = stop
        while True:
            high = self.text.find(" ", high + 1)
            if high < 0 or CUT.match(self.text, high):
                break
        high = size if high < 0 else high
        chars, tokens = self.counter.counted(text[low : high + len(text) - size])
        self.encoded += len(chars)
        first, before = self._find(low)
        last, before_last = self._find(max(high - 1, 0))
        a, b = self._leaf(first)
        kept = 0
        while before < low:
            before, kept = before + a[kept], kept + 1
        a, b = a[:kept], b[:kept]
        c, d = self._leaf(last)
        gone = 0
        while gone < len(c) and before_last < high:
            before_last, gone = before_last + c[gone], gone + 1
        touched = {first: (a + chars + c[gone:], b + tokens + d[gone:])} | {k: ([], []) for k in range(first + 1, last + 1)}
        self.changed |= touched
        self.text = text
        nodes = set()
        for k, (x, y) in touched.items():
            self.sums[:, self.half + k] = sum(x), sum(y)
            nodes.add((self.half + k) // 2)
        while nodes and nodes != {0}:  # level by level to the root
            for node in nodes:
                self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]
            self.renewed += len(nodes)
            nodes = {node // 2 for node in nodes}
        if len(touched[first][0]) > 16 * LEAF:
            self._rebuild()

    def _rebuild(self) -> None:
        """Even leaves again, after a long insertion."""
        parts = [self._leaf(k) for k in range(self.half)]
        encoded, renewed = self.encoded, self.renewed
        self.__init__(self.text, np.array([x for a, _ in parts for x in a], np.int32), np.array([x for _, b in parts for x in b], np.int32), self.counter)
        self.encoded, self.renewed = encoded, renewed


_counters: dict[str, Counter] = {}


def counter(ranks: str) -> Counter:
    if ranks not in _counters:
        _counters[ranks] = Counter(ranks)
    return _counters[ranks]


def recounted(df: DataFrame, key: str = "doc_id", text: str = "text", edits: str = "edits", ranks: str | None = None, texts: bool = False) -> DataFrame:
    """(key, n_tokens, n_tokens_edited, n_pretokens, n_reencoded, n_renewed[, text_edited]) of each row: its tokens before
    and after its edits (array<struct<start, stop, insert>>, applied in turn), its pre-tokens before them, the pre-tokens
    that were encoded again and the inner sums that were renewed."""
    ranks = ranks or vocabulary(df.sparkSession, RANKS)
    kind = df.schema[key].dataType.simpleString()
    names = ["key", "n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded", "n_renewed", *["text_edited"] * texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(ranks)
        for whole in batches:
            for batch in by_size(whole, 1, 1 << 20):
                bodies = [x or "" for x in batch.column(1).to_pylist()]
                rows = []
                for body, (chars, tokens), changes in zip(bodies, own.leaves(bodies), batch.column(2).to_pylist(), strict=True):
                    tree = Tree(body, chars, tokens, own)
                    before = tree.n_tokens
                    for change in changes or []:
                        if change is not None:
                            begin = change["start"] or 0
                            tree.edit(begin, begin if change["stop"] is None else change["stop"], change["insert"] or "")
                    rows.append((before, tree.n_tokens, len(chars), tree.encoded, tree.renewed, tree.text))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.string())] * texts
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    shape = "array<struct<start:int,stop:int,insert:string>>"
    kinds = f"key {kind}, n_tokens long, n_tokens_edited long, n_pretokens long, n_reencoded long, n_renewed long" + ", text_edited string" * texts
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(edits).cast(shape).alias("edits")).mapInArrow(run, kinds)


def usual_edits(text: Column) -> Column:
    """Three edits of every text: a replacement in its middle, an insertion in its first words, a deletion further on."""
    n = F.length(F.coalesce(text, F.lit("")))
    edit = lambda start, stop, insert: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(insert).alias("insert"))
    half, late = F.floor(n / 2), F.floor(n * 3 / 4)
    return F.array(edit(half, half + 5, "new words"), edit(F.lit(9), F.lit(9), " it's 2024,\n\n"), edit(late, late + 7, ""))


def op4(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_pretokens, n_reencoded and n_renewed of every document."""
    (edits,) = spare(documents, "edits")
    return recounted(documents.withColumn(edits, usual_edits(F.col("text"))), edits=edits).withColumnRenamed("key", "doc_id")
