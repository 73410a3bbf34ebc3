"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling.

Restaurants: a token is a customer of the restaurant of its context, which is the token before or the start of the text.
Every token has a restaurant of its own, however rare. Each table there sends one customer to the shared parent, the
unigram restaurant, and each table there one to the uniform distribution over the V known tokens and one unknown. A
context never met has an empty restaurant and leaves all to the parent.

Words that make up 1 / HEAD of the training tokens or more, and the end of a text, are frequent; they are fewer than
HEAD + 1, so what is known of them goes to every task. All else is dealt out by word to buckets of some BUCKET tokens,
each one row of arrays: a dish (a word in a context) belongs to its word, but if the word is frequent and the context is
not, to its context. So a bucket lacks only the totals of rare contexts of its rare words; before each sweep it is sent
these by the buckets of the contexts.

A sweep takes every customer out of a restaurant and seats it again given all others, and with each table that goes or
comes a customer of the parent, whose own customers are seated again as well. Table sizes are summed out: a random
customer of a dish with c customers at t tables sits alone with probability S(c-1, t-1) / S(c, t), S the generalised
Stirling numbers, and is seated again by the usual rule, so that the chain on tables has the posterior of the seating as
its law. Customers move one at a time in dishes of STEPS or fewer, a STEPS-th at a time in larger ones. The restaurants
of a word take turns, one after another up to TURNS of them, TURNS groups beyond. The totals of other words' tables,
and for dishes of frequent words in rare contexts the parent, are as of the sweep's begin (the usual approximation of a
distributed Gibbs sampler). Dishes with one customer and words that occur once have one table and are not moved.
Predictive probabilities are averaged over the sweeps after BURN. Discounts come from the counts of counts, strengths
are fixed.

Scoring reads the corpus again. Pairs of frequent words are looked up in a table in every task, all others in the bucket
of their dish, to which the tasks send the pairs of a stretch of text once each, for a share of 1 / SLICES of the texts
at a time.

Rows of arrays pass the JVM in pieces of PIECE bytes, in row groups of GROUP_ROWS and batches of as many, so that its memory
does not depend on how large a bucket is.

Defined results: a null text is empty and has one token, its end; a null doc_id is held out; repeated rows are scored
each; without training tokens every token is unknown with probability 1; an empty table gives an empty result.
Words are known by 64-bit hashes.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, delete, give_back, splitmix, through_python, written

HEAD = 4096
BUCKET = 4_000_000  # training tokens of a bucket
BUCKETS = 32  # at least, of a corpus that has SPARSE tokens for each
SPARSE = 50_000
SLICES = 4  # of the texts, scored one after another
SWEEPS = 6
BURN = 2  # sweeps whose states are not used
STEPS = 16  # in which a dish's customers are seated again
TURNS = 8  # in which a word's restaurants are taken
EXACT = 384  # customers up to which the chance to sit alone is tabulated; beyond, it is scaled
FLUSH = 500_000  # distinct words a task holds
GROUP = 1 << 20  # bytes of texts a task works on at once
PAIRS = 1_000_000  # tokens whose pairs are counted together
PIECE = 1 << 17  # bytes of a bucket's content in a row
SLOTS = 1 << 18  # in which a task finds words it has met without a search
GROUP_ROWS = 128  # pieces read or sent at once
LAYOUT = {"parquet.block.row.count.limit": GROUP_ROWS, "parquet.page.row.count.limit": 8, "parquet.page.size.row.check.min": 8}
END = b"\n"  # no word holds a blank
STRENGTH = 1.0  # of every restaurant


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_TOP = np.uint64(1 << 63)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """:func:`_hash` of words, given by where they start and how many bytes they have; eight bytes more follow the last.
    Words of a size under 32 are hashed together, by what XXH64 does to so few bytes."""
    out = np.empty(len(start), np.int64)
    short = np.minimum(size, 32).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    ends = np.cumsum(np.bincount(short, minlength=33)).tolist()
    eight, four = (np.ndarray((len(data) - 8,), kind, data, strides=(1,)) for kind in ("<u8", "<u4"))
    with np.errstate(over="ignore"):
        for n in range(1, 32):
            which = order[ends[n - 1] : ends[n]]
            if not len(which):
                continue
            at = start[which]
            acc = np.full(len(at), _P5 + np.uint64(n), np.uint64)
            for k in range(0, n - 7, 8):
                acc = _turned(acc ^ _turned(eight[at + k] * _P2, 31) * _P1, 27) * _P1 + _P4
            if n & 4:
                acc = _turned(acc ^ four[at + (n & 24)].astype(np.uint64) * _P1, 23) * _P2 + _P3
            for k in range(n & 28, n):
                acc = _turned(acc ^ data[at + k].astype(np.uint64) * _P5, 11) * _P1
            acc = (acc ^ (acc >> np.uint64(33))) * _P2
            acc = (acc ^ (acc >> np.uint64(29))) * _P3
            out[which] = (acc ^ (acc >> np.uint64(32)) ^ _TOP).view(np.int64)
    whole = memoryview(data)
    for k in order[ends[31] :].tolist():
        out[k] = _hash(whole[int(start[k]) : int(start[k]) + int(size[k])])
    return out


class Seen:
    """Words a task has met, each at a place: its hash there, and what ``lookups`` have for the hash, or -1."""

    def __init__(self, *lookups: dict[int, int]) -> None:
        keys = [np.array(sorted(x), np.int64) for x in lookups]
        self.lookups, self.turn = [(k, np.array([x[h] for h in k.tolist()], np.int32)) for k, x in zip(keys, lookups, strict=True)], 0
        self.clear()

    def clear(self) -> None:
        self.turn += 1
        self.hashes, self.ordered, self.at = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.found = [np.empty(0, np.int32) for _ in self.lookups]
        self.slots = np.zeros(SLOTS, np.int32)  # places by the last bits of a hash; what stands there is compared

    def places(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & (SLOTS - 1)
        at = self.slots.take(slot).astype(np.int64)
        others = _hits(self.hashes.take(at) != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(others):
            at[others] = got = self._searched(hashes[others])
            free = self.slots.take(slot[others]) == 0
            self.slots[slot[others[free]]] = got[free]
        return at

    def _searched(self, hashes: np.ndarray) -> np.ndarray:
        names, which = np.unique(hashes, return_inverse=True)
        where = np.searchsorted(self.ordered, names)
        fresh = np.append(self.ordered, 0)[where] != names
        fresh |= where == len(self.ordered)
        if (new := names[fresh]).size:
            self.at = np.insert(self.at, where[fresh], np.arange(len(self.hashes), len(self.hashes) + len(new)))
            self.ordered = np.insert(self.ordered, where[fresh], new)
            self.hashes = np.concatenate((self.hashes, new))
            for j, (keys, values) in enumerate(self.lookups):
                k = _find(keys, new)
                self.found[j] = np.concatenate((self.found[j], np.where(k >= 0, values[k], -1).astype(np.int32) if len(keys) else np.full(len(new), -1, np.int32)))
            where = where + np.cumsum(fresh) - fresh
        return self.at[where][which]

    @property
    def index(self) -> dict[bytes, int]:
        """The words of the last stretch and their places."""
        data, start, size, at, end = self.last
        return {data[a : a + n].tobytes(): k for a, n, k in zip(start.tolist(), size.tolist(), at.tolist(), strict=True)} | {END: end}


_LOWER = np.array([k + 32 if 65 <= k <= 90 else k for k in range(256)], np.uint8)
_SOLID = np.array([k not in b" \t\n\x0b\x0c\r" for k in range(256)])


def _grouped(batches: Iterator[pa.RecordBatch], column: int, seen: Seen) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Stretches of the batches of some GROUP bytes: the rows, the places in ``seen`` of their tokens, and how many each
    has. Texts are split (A-Z lower-cased, at the six ASCII blanks) and words hashed as arrays of bytes, so no word
    becomes a Python object."""
    end = _hash(END)
    for whole in batches:
        for batch in by_size(whole, column, GROUP):
            if len(seen.hashes) > FLUSH:
                seen.clear()
            texts = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
            _, offsets, content = texts.buffers()
            cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            n = int(cuts[-1] - cuts[0])
            data = np.zeros(n + 8, np.uint8)
            if n:
                data[:n] = _LOWER[np.frombuffer(content, np.uint8)[cuts[0] : cuts[-1]]]
            cuts = cuts - cuts[0]
            solid = _SOLID[data[:n]]
            # where a word starts or ends: beside a blank, or beside the edge of a text
            starts, stops = solid.copy(), solid.copy()
            starts[1:] &= ~solid[:-1]
            stops[:-1] &= ~solid[1:]
            edges = cuts[:-1][cuts[1:] > cuts[:-1]]
            starts[edges] = solid[edges]
            stops[edges[1:] - 1] = solid[edges[1:] - 1]
            start = np.flatnonzero(starts)
            size = np.flatnonzero(stops) + 1 - start
            counts = np.diff(np.searchsorted(start, cuts)) + 1
            ends = np.zeros(int(counts.sum()), bool)
            ends[np.cumsum(counts) - 1] = True
            hashes = np.full(len(ends), end)
            hashes[~ends] = _hashes(data, start, size)
            at = seen.places(hashes)
            seen.last = data, start, size, at[~ends], int(at[-1])
            yield batch, at, counts


def _occurrences(documents: DataFrame) -> DataFrame:
    """(h, c): how often each word occurs, pre-aggregated by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hashes, sums, turn = Seen(), np.empty(0, np.int64), np.empty(0, np.int64), 1
        for _, at, _ in _grouped(batches, 0, seen):
            if seen.turn > turn:  # it has been emptied
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(sums)], names=["h", "c"])
                sums, turn = np.empty(0, np.int64), seen.turn
            hashes, found = seen.hashes, np.bincount(at, minlength=len(seen.hashes))
            found[: len(sums)] += sums
            sums = found
        if len(sums):
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(sums)], names=["h", "c"])

    return through_python(documents.where(~F.col("held_out")).select("text"), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


ROW = "part int, what string, chunk long, piece int, blob binary, sums array<long>"
ARROW_ROW = pa.schema([("part", pa.int32()), ("what", pa.string()), ("chunk", pa.int64()), ("piece", pa.int32()), ("blob", pa.binary()), ("sums", pa.list_(pa.int64()))])


def _small(x: np.ndarray) -> np.ndarray:
    """The same integers, none negative, in the smallest type."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _wide(kind: str, shape: tuple[int, ...], low: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = low.astype(kind)
    out[low == 255] = large
    return out.reshape(shape)


class _Pickler(pickle.Pickler):
    """Writes arrays of integers of which most are small as bytes, and those from 255 on apart."""

    def reducer_override(self, x: object) -> object:
        if type(x) is np.ndarray and x.dtype.kind in "iu" and x.itemsize > 1 and x.size > 64 and x.min() >= 0:
            flat = x.ravel()
            large = flat >= 255
            if 8 * np.count_nonzero(large) <= flat.size:
                return _wide, (x.dtype.str, x.shape, np.minimum(flat, 255).astype(np.uint8), flat[large])
        return NotImplemented


def _packed(content: object) -> bytes:
    out = io.BytesIO()
    _Pickler(out, 5).dump(content)
    return out.getvalue()


def _row(part: int, what: str, content: object = None, chunk: int = 0, sums: list[int] | None = None) -> dict:
    return {"part": part, "what": what, "chunk": chunk, "blob": _packed(content), "sums": sums}


def _rows(rows: list[dict], keys: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in pieces, some at once. ``keys``, if any, go with the first."""
    schema = ARROW_ROW if keys is None else ARROW_ROW.append(pa.field("keys", pa.list_(keys.type)))
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(held, schema=schema)

    for number, row in enumerate(rows):
        for piece in range(max(1, -(-len(row["blob"]) // PIECE))):
            blob = row["blob"][piece * PIECE : (piece + 1) * PIECE]
            first = {"sums": row["sums"]} | ({"keys": keys.to_pylist()} if keys is not None and number == 0 else {}) if piece == 0 else {}
            held.append(row | {"sums": None, "piece": piece, "blob": blob} | first)
            size += len(blob)
            if len(held) == GROUP_ROWS or size > 16 * PIECE:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _contents(table: pa.Table, by: str = "chunk") -> Iterator[tuple[str, int, object]]:
    """What the rows hold, put together from its pieces, by kind and ``by``, ordered by these."""
    what, number, piece, blob = (table[x].to_pylist() if x != "blob" else table[x] for x in ("what", by, "piece", "blob"))
    order = sorted(range(len(what)), key=lambda k: (what[k], number[k], piece[k]))
    for (kind, which), own in groupby(order, key=lambda k: (what[k], number[k])):
        yield kind, which, pickle.loads(b"".join([blob[k].as_py() for k in own]))  # noqa: S301


def _kept(rows: DataFrame, label: str) -> DataFrame:
    """:func:`written` for tables whose rows are large, in small row groups."""
    return written(rows, label, **LAYOUT)


def _by_part(rows: DataFrame, run: Callable[[int, dict[str, list]], list[dict]]) -> DataFrame:
    """``run`` over each part's rows: their contents by kind, as (chunk, content)."""

    def one(table: pa.Table) -> pa.Table:
        found: dict[str, list] = {}
        part = table["part"][0].as_py()
        for what, chunk, content in _contents(table):
            found.setdefault(what, []).append((chunk, content))
        try:
            return pa.Table.from_batches(_rows(run(part, found)), schema=ARROW_ROW)
        finally:  # workers live on, and stand idle while others work
            found.clear()
            give_back()

    return rows.groupBy("part").applyInArrow(one, ROW)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (np.ascontiguousarray(h).view(np.uint64) % np.uint64(parts)).astype(np.int64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    return x[first], _small(np.diff(np.append(first, len(x))))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Ascending, each once. ``np.unique`` keeps a hash table, which takes many times as long as sorting."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _grouping(x: np.ndarray) -> np.ndarray:
    """The order that puts small numbers, none negative, in groups and changes nothing inside of these: of 16 bits they
    are sorted by their digits."""
    return np.argsort(_small(x), kind="stable")


def _split(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each of some small numbers, ascending, and where it stands."""
    order = _grouping(x)
    first, size = _runs(x[order])
    ends = np.cumsum(size, dtype=np.int64)
    for k, a, b in zip(first.tolist(), (ends - size).tolist(), ends.tolist(), strict=True):
        yield k, order[a:b]


def _ranked(at: np.ndarray, n: int, names: np.ndarray) -> np.ndarray:
    """Keys in the order of ``at``, all below ``n``, and then of 64-bit names, whose last bits have no room in them. That of
    -1 is negative."""
    bits = n.bit_length()
    return (at << (63 - bits)) | ((names.view(np.uint64) ^ _TOP) >> np.uint64(bits + 1)).view(np.int64)


def _find_ranked(keys: np.ndarray, names: np.ndarray, x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places of ``x`` with the names ``own`` among ascending :func:`_ranked` keys of ``names``, or -1."""
    at = _find(keys, x)
    off = _hits((at >= 0) & (names[at] != own)) if len(names) else _hits(at >= 0)
    while off.size:  # other names that differ in their last bits only
        after = at[off] + 1
        there = np.minimum(after, len(keys) - 1)
        at[off] = np.where((after < len(keys)) & (keys[there] == x[off]), after, -1)
        off = off[at[off] >= 0]
        off = off[names[at[off]] != own[off]]
    return at


def _heads(contexts: dict[int, int]) -> dict[int, int]:
    """Places of frequent words. That of the end, as a word, is that of the start, as a context."""
    return contexts | {_hash(END): len(contexts)}


def _chunks(batches: Iterator[pa.RecordBatch], column: int, heads: dict[int, int]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some PAIRS tokens at once: rows, places of the tokens and of those before (-1: none), how many a text has, and by
    place the hash and the place among the frequent words (-1: none). Places here are in the order of hashes."""
    seen, held, n, turn, hashes, found, order = Seen(heads), [], 0, 1, np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)

    def out() -> tuple:
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        at, counts = rank.take(np.concatenate([x[1] for x in held])), np.concatenate([x[2] for x in held])
        before = np.empty_like(at)
        before[1:] = at[:-1]
        before[np.concatenate(([0], np.cumsum(counts)[:-1]))] = -1
        return [x[0] for x in held], at, before, counts, hashes[order], found[order]

    for stretch in _grouped(batches, column, seen):
        if seen.turn > turn:  # it has been emptied
            if held:
                yield out()
            held, n, turn = [], 0, seen.turn
        hashes, found, order = seen.hashes, seen.found[0], seen.at
        held.append((stretch[0], stretch[1].astype(np.int32), stretch[2]))
        n += len(stretch[1])
        if n > PAIRS:
            whole = out()
            held, n = [], 0
            yield whole
            del whole
    if held:
        yield out()


def _sorted(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits in order, and the order: where they and their places have room in 64 bits, these are sorted
    as one number, which is faster."""
    room = len(keys).bit_length()
    if bits + room > 63:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = np.sort((keys << room) | np.arange(len(keys)))
    return both >> room, both & ((1 << room) - 1)


def _pair(at: np.ndarray, before: np.ndarray, places: int) -> np.ndarray:
    return (at.astype(np.int64) << places.bit_length()) | (before + 1)


def _dishes(key: np.ndarray, hashes: np.ndarray, heads: np.ndarray, start: int, parts: int) -> tuple[np.ndarray, ...]:
    """Of ascending keys by :func:`_pair` the order in which they are sent, and in that order group, owner, other word and
    place before. Of the groups, 3 * part + kind, the kind is 0: a word by the place of its frequent context, 1: a rare
    context by the place of its frequent word, 2: a word by the hash of its context. Owners of a group ascend."""
    bits = len(hashes).bit_length()
    at, before = key >> bits, (key & ((1 << bits) - 1)) - 1
    word, ctx = heads.take(at), np.where(before < 0, start, heads.take(before))
    names = hashes.take(before)
    apart = (word >= 0) & (ctx < 0)
    owner = np.where(apart, names, hashes.take(at))
    other = np.where(apart, word, np.where(ctx < 0, names, ctx))
    group = 3 * _part(owner, parts) + np.where(apart, 1, np.where(ctx < 0, 2, 0))
    order, theirs = np.arange(len(key)), _hits(apart)
    order[theirs] = theirs[_sorted(before[theirs], bits)[1]]
    order = order[_grouping(group[order])]
    return order, group.take(order), owner.take(order), other.take(order), before.take(order)


def _cut(group: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    """Part, kind and place of each run of ``group``."""
    first, size = _runs(group)
    at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    for g, a, b in zip(first.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield g // 3, g % 3, slice(a, b)


def _sent(documents: DataFrame, contexts: dict[int, int], parts: int) -> DataFrame:
    """How often each pair of words occurs, pre-aggregated by task, as rows for the buckets: by kind owners, how many
    dishes each has, the other words, and counts."""
    heads, start = _heads(contexts), len(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (_, at, before, _, hashes, found) in enumerate(_chunks(batches, 0, heads)):
            key, c = np.unique(_pair(at, before, len(hashes)), return_counts=True)
            order, group, owner, other, _ = _dishes(key, hashes, found, start, parts)
            c = c[order]
            content: dict[int, dict] = {}
            for part, kind, s in _cut(group):
                content.setdefault(part, {})[kind] = (*_runs(owner[s]), other[s] if kind == 2 else _small(other[s]), _small(c[s]))
            yield from _rows([_row(part, "pairs", x, task << 24 | number) for part, x in content.items()])

    return through_python(documents.where(~F.col("held_out")).select("text"), run, ROW)


def _merged(blobs: list[tuple[int, dict]], kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, other and count of each dish of a kind, ordered by these."""
    some = [x[kind] for _, x in blobs if kind in x]
    if not some:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    names, at = np.unique(np.concatenate([x[0] for x in some]), return_inverse=True)
    at = np.repeat(at, np.concatenate([x[1] for x in some]))
    other, c = np.concatenate([x[2].astype(np.int64) for x in some]), np.concatenate([x[3].astype(np.int64) for x in some])
    key = _ranked(at, len(names), other) if kind == 2 else at * (int(other.max(initial=0)) + 1) + other
    order = np.argsort(key)
    key, to = key[order], other[order]
    if kind == 2 and ((key[1:] == key[:-1]) & (to[1:] != to[:-1])).any():  # names that differ in their last bits only
        order = np.lexsort((other, at))
    at, other, c = at[order], other[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (other[1:] != other[:-1]))))
    return names[at[first]], other[first], np.add.reduceat(c, first)


def _pairs(documents: DataFrame, contexts: dict[int, int]) -> DataFrame:
    """(h, ctx, c): how often each word occurs in each context, all without a place as one, from the rows for buckets."""
    names, rest = {k: h for h, k in _heads(contexts).items()}, len(contexts) + 1

    def run(table: pa.Table) -> pa.Table:
        out = []
        for _, _, content in _contents(table):
            for kind in (0, 1, 2):
                owner, other, c = _merged([(0, content)], kind)
                h = np.array([names[k] for k in other.tolist()], np.int64) if kind == 1 else owner
                ctx = other if kind == 0 else np.full(len(other), rest)
                out.append(pa.table([pa.array(h), pa.array(ctx.astype(np.int32)), pa.array(c)], names=["h", "ctx", "c"]))
        return pa.concat_tables(out)

    return _sent(documents, contexts, 1).groupBy("chunk").applyInArrow(run, "h long, ctx int, c long").groupBy("h", "ctx").agg(F.sum("c").alias("c"))


def first_tables(customers: np.ndarray, chance: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables to begin with: what customers who come one after another take on average, rounded by ``u``. ``chance``:
    weight of a new table, against that of k customers at t tables, k - discount * t. Long stretches go at once."""
    tables, k, most = np.ones(len(customers)), 1, int(customers.max(initial=1))
    while k < most:
        block = max(1, k // 8)
        tables += np.clip(customers - k, 0, block) * chance / (chance + np.maximum(k - discount * tables, 0))
        k += block
    return np.clip(np.floor(tables + u), 1, customers).astype(np.int64)


_alone: dict[float, np.ndarray] = {}


def alone_table(discount: float) -> np.ndarray:
    """[c, t]: chance that a customer of a dish with c customers at t tables sits alone, for c and t up to EXACT."""
    if discount not in _alone:
        number = np.full((EXACT + 1, EXACT + 1), -np.inf)  # logarithms of generalised Stirling numbers
        chance, t = np.zeros((EXACT + 1, EXACT + 1)), np.arange(EXACT + 1)
        number[0, 0] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in range(1, EXACT + 1):
                stay = number[c - 1] + np.log(np.maximum(c - 1 - discount * t, 0))
                new = np.concatenate(([-np.inf], number[c - 1, :-1]))
                number[c] = np.logaddexp(stay, new)
                chance[c, 1 : c + 1] = np.exp(new - number[c])[1 : c + 1]
        _alone[discount] = chance
    return _alone[discount]


def _hits(x: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a flat array, without the checks that take longer than a short one."""
    return x.nonzero()[0]


def alone(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Chance that a customer sits alone. Beyond EXACT customers the share of tables with one customer is taken from the
    dish of EXACT customers whose tables are as many in proportion to customers ** discount."""
    table = alone_table(discount)
    if c.max(initial=0) <= EXACT and t.max(initial=0) <= EXACT:
        return table.ravel().take(c * (EXACT + 1) + t)
    out = table.ravel().take(np.minimum(c, EXACT) * (EXACT + 1) + np.minimum(t, EXACT))
    large = _hits((c > EXACT) | (t > EXACT))
    if len(large):
        many, tables = c[large].astype(float), t[large].astype(float)
        like = np.clip(1 + (tables - 1) * (EXACT / many) ** discount, 1, EXACT)
        low = np.minimum(like.astype(int), EXACT - 1)
        share = table[EXACT, low] + (like - low) * (table[EXACT, low + 1] - table[EXACT, low])
        out[large] = np.where(tables >= many, 1.0, np.minimum(1.0, share * EXACT / like * tables / many))
    return out


def drawn(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial counts, each from its own uniform number alone, so that they don't depend on what is drawn beside them: by
    summing up the law, and where both outcomes are expected over 40 times by its normal form with the term for skew."""
    if n.max(initial=0) <= 1:
        return (n * p + u >= 1).astype(np.int64)
    out = np.floor(n * p + u)
    many = _hits(n > 1)
    if len(many):
        size, q, v = n[many].astype(float), np.fmin(np.fmax(p[many], 0.0), 1.0), 1 - u[many]  # no number: 0
        flip = q > 0.5
        q, v = np.where(flip, 1 - q, q), np.where(flip, 1 - v, v)
        mean = size * q
        got = np.zeros(len(many))
        large = _hits(mean > 40)
        if len(large):
            z = _normal(v[large])
            got[large] = np.rint(mean[large] + np.sqrt(mean[large] * (1 - q[large])) * z + (1 - 2 * q[large]) * (z * z - 1) / 6)
        live = _hits((mean <= 40) & (q > 0))
        of, q = size[live], q[live]
        odds, mass = q / (1 - q), np.exp(of * np.log1p(-q))
        left, k, count = v[live] - mass, 0, np.zeros(len(live))
        while some := np.count_nonzero(on := (left > 0) & (of > k)):
            if 4 * some < 3 * len(on):  # those that are done go
                got[live] = count
                live, of, odds, mass, left, count = live[on], of[on], odds[on], mass[on], left[on], count[on]
                count += 1
            else:
                count += on
            mass *= of - k
            mass /= k + 1
            mass *= odds
            left -= mass
            k += 1
        got[live] = count
        out[many] = np.where(flip, size - got, got)
    return np.minimum(np.maximum(out, 0), n).astype(np.int64)


def _normal(u: np.ndarray) -> np.ndarray:
    """Quantiles of the normal law, to some 4e-4: Abramowitz and Stegun, 26.2.23."""
    t = np.sqrt(-2 * np.log(np.clip(np.minimum(u, 1 - u), 1e-12, None)))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return np.where(u < 0.5, -z, z)


def reseated(word: np.ndarray, cs: np.ndarray, ts: np.ndarray, t1: np.ndarray, others: np.ndarray, parents: tuple[float, float], known: int, discounts: tuple[float, float], seed: np.ndarray, still: np.ndarray | None = None, roots_seed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tables after a sweep. Rows are dishes of restaurants: their word (ascending), customers and tables; ``t1`` are the
    words' tables in the parent, ``others`` the tables of a row's restaurant that belong to other words, ``parents`` all
    customers and tables of the parent as of the sweep's begin, ``seed`` a counter a row. ``still``: tables of words that
    are not among the rows and stay; words may then have no row, so ``roots_seed`` has a counter a word."""
    ts, t1, n, (d, d1) = ts.copy(), t1.copy(), len(t1), discounts
    c1 = np.bincount(word, ts, n).astype(np.int64) + (0 if still is None else still)
    rest_c, rest_t = parents[0] - c1, parents[1] - t1  # of other words
    live = _hits(cs > 1)
    many = np.bincount(word[live], minlength=n)
    turn = (np.arange(len(live)) - np.repeat(np.cumsum(many) - many, many)) % np.minimum(many, TURNS)[word[live]] if len(live) else live
    size = -(-cs // STEPS)  # customers of a step
    steps = -(-cs // size)
    # by turn, and those with the most steps first, so that the rows of a step are the first of their turn
    order = np.lexsort((-steps[live], turn))
    turns = np.split(live[order], np.searchsorted(turn[order], np.arange(1, TURNS)))
    parts = [-steps[x] for x in turns]
    busy, place = _hits(many), np.zeros(len(cs), np.int64)  # words with such dishes
    place[live] = np.searchsorted(busy, word[live])
    roots = np.argsort(-c1, kind="stable")
    begin = -c1[roots]
    # what the rows of a turn have, side by side
    own = [[x[rows] for x in (size, word, place, cs, others, ts, seed, rest_c[word], rest_t[word])] for rows in turns]
    last = (seed[np.searchsorted(word, np.arange(n))] if roots_seed is None else roots_seed) ^ np.uint64(0xA5A5A5A5A5A5A5A5)  # a counter a word

    def uniforms(counters: np.ndarray, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers of 32 bits from one draw, never 0."""
        counters[at] = got = splitmix(counters[at])
        return ((got >> np.uint64(32)).astype(float) + 0.5) / 4294967296.0, ((got & np.uint64(0xFFFFFFFF)).astype(float) + 0.5) / 4294967296.0

    def parent_new(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of a new table in the parent and of the tables there."""
        return (STRENGTH + d1 * (rest_t[at] + t1[at])) / (known + 1), np.maximum(c1[at] - d1 * t1[at], 0.0)

    for step in range(STEPS):
        for mine, part in zip(own, parts, strict=True):
            at = slice(int(np.searchsorted(part, -step)))
            if not at.stop:
                continue
            m, w, of, customers, there, tables, _, c_there, t_there = (x[at] for x in mine)
            u, v = uniforms(mine[6], at)
            gone = np.minimum(drawn(m, alone(customers, tables, d), u), tables - 1)
            if (hit := _hits(gone)).size:
                lost = np.bincount(of[hit], gone[hit], len(busy)).astype(np.int64)
                lost, which = lost[(some := _hits(lost))], busy[some]
                t1[which] -= np.minimum(drawn(lost, alone(c1[which], t1[which], d1), uniforms(last, which)[0]), t1[which])
                c1[which] -= lost
                tables -= gone
            c_own, t_own = c1.take(w), t1.take(w)
            new, old = (STRENGTH + d1 * (t_there + t_own)) / (known + 1), np.maximum(c_own - d1 * t_own, 0.0)
            fresh, stay = (STRENGTH + d * (there + tables)) * (new + old) / (STRENGTH + c_there + c_own), np.maximum(customers - m - d * tables, 0.0)
            born = drawn(m, fresh / (fresh + stay), v)
            tables += born
            if (hit := _hits(born)).size:
                got = np.bincount(of[hit], born[hit], len(busy)).astype(np.int64)
                got, which = got[(some := _hits(got))], busy[some]
                new, old = parent_new(which)
                t1[which] += drawn(got, new / (new + old), uniforms(last, which)[0])
                c1[which] += got
        t1[busy] = np.clip(t1[busy], 1, c1[busy])
        # the parent's own customers
        at = roots[: np.searchsorted(begin, -max(step, 1))]
        at = at[c1[at] > 1]
        m = -(-c1[at] // STEPS)
        u, v = uniforms(last, at)
        t1[at] -= np.minimum(drawn(m, alone(c1[at], t1[at], d1), u), t1[at] - 1)
        new = (STRENGTH + d1 * (rest_t[at] + t1[at])) / (known + 1)
        t1[at] = np.clip(t1[at] + drawn(m, new / (new + np.maximum(c1[at] - m - d1 * t1[at], 0.0)), v), 1, c1[at])
    for rows, mine in zip(turns, own, strict=True):
        ts[rows] = mine[5]
    return ts, t1


def moved(cs: np.ndarray, ts: np.ndarray, others: np.ndarray, chance: np.ndarray, discount: float, seed: np.ndarray) -> np.ndarray:
    """Tables of dishes after a sweep as in :func:`reseated`, where the parent's probability ``chance`` stays."""
    ts, size = ts.copy(), -(-cs // STEPS)
    steps = np.where(cs > 1, -(-cs // size), 0)
    order = np.argsort(-steps, kind="stable")
    begin = -steps[order]
    order = order[: np.searchsorted(begin, 0)]
    own = [x[order] for x in (size, cs, others, chance, ts, seed)]
    for step in range(STEPS):
        at = slice(int(np.searchsorted(begin, -step)))
        if not at.stop:
            break
        m, customers, elsewhere, parent, tables, counters = (x[at] for x in own)
        counters[:] = got = splitmix(counters)
        u, v = ((got >> np.uint64(32)).astype(float) + 0.5) / 4294967296.0, ((got & np.uint64(0xFFFFFFFF)).astype(float) + 0.5) / 4294967296.0
        tables -= np.minimum(drawn(m, alone(customers, tables, discount), u), tables - 1)
        fresh, there = (STRENGTH + discount * (elsewhere + tables)) * parent, np.maximum(customers - m - discount * tables, 0.0)
        tables += drawn(m, fresh / (fresh + there), v)
    ts[order] = own[4]
    return ts


class Totals:
    """What a task needs of the other words: customers and tables of each frequent restaurant (the last one is empty),
    all tables, those in the parent, and of the frequent words the tables in rare contexts, in all and in the parent."""

    def __init__(self, customers: np.ndarray, sums: np.ndarray, known: int, discounts: tuple[float, float] | None) -> None:
        k = len(customers) - 1
        tables, rare, here, roots, rest = np.split(sums.astype(float), [k + 1, 2 * k + 1, 3 * k + 1, 4 * k + 1])
        self.customers, self.tables, self.known = customers.astype(float), tables, known
        self.apart, self.head_customers, self.head_tables = rare, here + rare, roots
        self.total, self.parent_tables = float(tables.sum() + rare.sum() + rest[0]), float(rest[1])
        if discounts is None:  # absolute discounts from how many dishes have one and two customers
            rate = lambda a, b: min(max(a / (a + 2 * b), 0.05), 0.95) if a + b else 0.5
            discounts = rate(*rest[2:4].tolist()), rate(*(rest[4 + j] + np.count_nonzero(self.head_customers == j + 1) for j in (0, 1)))
        self.discount, self.parent_discount = discounts

    @property
    def backoff(self) -> np.ndarray:
        """What each frequent restaurant leaves to its parent."""
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of words with so many customers and tables there."""
        rest = (STRENGTH + self.parent_discount * self.parent_tables) / (STRENGTH + self.total)
        return np.maximum(customers - self.parent_discount * tables, 0) / (STRENGTH + self.total) + rest / (self.known + 1)


def _find(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in ascending values, or -1."""
    if not len(values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return np.where(values[at] == x, at, -1)


def _sums(state: dict, places: int) -> list[int]:
    """The sums of a bucket that :class:`Totals` splits."""
    rare, head = state["ctx"] < 0, state["place"] >= 0
    tables = state["still_ctx"] + np.bincount(state["ctx"][~rare], state["ts"][~rare], places + 1).astype(np.int64)
    apart = state["still_head"] + np.bincount(state["w"], state["bt"], places).astype(np.int64)
    here, roots = np.zeros(places, np.int64), np.zeros(places, np.int64)
    here[state["place"][head]] = (np.bincount(state["word"], state["ts"], len(state["h"])) + state["still"])[head]
    roots[state["place"][head]] = state["t1"][head]
    rest = [state["still_rest"] + int(state["ts"][rare].sum()), state["roots"] + int(state["t1"].sum()), *state["counted"]]
    return np.concatenate((tables, apart, here, roots, rest)).astype(np.int64).tolist()


def _kept_state(state: dict) -> dict:
    """The state as it is written: ascending places as steps, no names but those of rare contexts."""
    return state | {"word": np.diff(state["word"], prepend=0), "node": np.diff(state["node"], prepend=0), "ctx": (state["ctx"] + 1).astype(np.int16), "u": state["u"][state["ctx"] < 0], "w": _small(state["w"])}


def _read_state(kept: dict) -> dict:
    ctx = kept["ctx"].astype(np.int64) - 1
    u = np.zeros(len(ctx), np.int64)
    u[ctx < 0] = kept["u"]
    return kept | {"word": np.cumsum(kept["word"]), "node": np.cumsum(kept["node"]), "ctx": ctx, "u": u, "w": kept["w"].astype(np.int64)}


def _asked(state: dict, part: int, parts: int, singles: np.ndarray | None = None) -> list[dict]:
    """What the buckets of rare contexts need and are asked: the tables of rare words there."""
    rare = state["ctx"] < 0
    u, t = state["u"][rare], state["ts"][rare]
    if singles is None:
        singles = np.empty(0, np.int64)
    names, at = np.unique(np.concatenate((u, singles)), return_inverse=True)
    tables, still = np.bincount(at[: len(u)], t, len(names)).astype(np.int64), np.bincount(at[len(u) :], minlength=len(names))
    out = [_row(k, "tables", (names[s], _small(tables[s]), _small(still[s])), part) for k, s in _split(_part(names, parts))]
    return [*out, _row(part, "own", (state["h"], state["fixed"] + np.bincount(state["node"], state["bt"], len(state["h"])).astype(np.int64)))]


def _built(contexts: dict[int, int], counts: list[int], parts: int) -> Callable:
    """A bucket from the counts: all dishes, and the state of those that move, with one table each."""
    names = np.array(list(_heads(contexts)), np.int64)
    often, places = np.array(counts, np.int64), len(names)

    def run(part: int, found: dict[str, list]) -> list[dict]:
        (w0, x0, c0), (u1, x1, c1), (w2, x2, c2) = (_merged(found["pairs"], kind) for kind in (0, 1, 2))
        h = _distinct(np.concatenate((w0, w2, names[(_part(names, parts) == part) & (often > 0)])))
        by_name = np.argsort(names)
        place = _find(names[by_name], h)
        place = np.where(place >= 0, by_name[place], -1)
        word = np.searchsorted(h, np.concatenate((w0, w2)))
        order = np.argsort(word, kind="stable")
        word, c = word[order], np.concatenate((c0, c2))[order]
        ctx, u = np.concatenate((x0, np.full(len(x2), -1)))[order], np.concatenate((np.zeros(len(x0), np.int64), x2))[order]
        node = np.searchsorted(h, u1)
        many = np.where(place >= 0, often[place], np.bincount(word, c, len(h)).astype(np.int64))
        moving = np.flatnonzero(many > 1)
        new = np.full(len(h), -1)
        new[moving] = np.arange(len(moving))
        live, apart, rare = c > 1, c1 > 1, ctx < 0
        dishes = np.bincount(word, minlength=len(h))[place < 0]
        state = {
            "h": h[moving], "place": place[moving], "c": many[moving], "t1": np.ones(len(moving), np.int64), "samples": [],
            "still": np.bincount(word[~live], minlength=len(h))[moving], "fixed": np.bincount(node[~apart], minlength=len(h))[moving],
            "word": new[word[live]], "ctx": ctx[live], "u": u[live], "cs": c[live], "ts": np.ones(int(live.sum()), np.int64), "sum": np.zeros(int(live.sum()), np.int64),
            "node": new[node[apart]], "w": x1[apart], "bc": c1[apart], "bt": np.ones(int(apart.sum()), np.int64), "bsum": np.zeros(int(apart.sum()), np.int64),
            "still_ctx": np.bincount(ctx[~live & ~rare], minlength=places + 1), "still_head": np.bincount(x1[~apart], minlength=places), "still_rest": int((~live & rare).sum()), "roots": len(h) - len(moving),
            "counted": [int((c == k).sum() + (c1 == k).sum()) for k in (1, 2)] + [int((dishes == k).sum()) for k in (1, 2)],
        }
        static = {"h": h, "place": place, "c": _small(many), "word": _runs(word), "ctx": (ctx + 1).astype(np.int16), "u": u[rare], "cs": _small(c), "node": _runs(node), "w": _small(x1), "bc": _small(c1)}
        return [_row(part, "static", static), _row(part, "state", _kept_state(state)), _row(part, "sums", None, 0, _sums(state, places)), *_asked(state, part, parts, u[~live & rare])]

    return run


def _answered(part: int, found: dict[str, list]) -> list[dict]:
    """The tables of a bucket's contexts, to itself and to the buckets that have dishes there."""
    h, tables = found["own"][0][1]
    still = np.zeros(len(h), np.int64)
    met = []
    for sender, (u, t, s) in found.get("tables", []):
        at = _find(h, u)  # a context with one customer doesn't move
        here = _hits(at >= 0)  # each once
        still[at[here]] += s[here]
        tables[at[here]] += t[here].astype(np.int64) + s[here]
        met.append((sender, u[t > 0], at[t > 0]))
    return [_row(part, "self", (tables, still)), *(_row(sender, "totals", (u, _small(tables[at])), part) for sender, u, at in met)]


def _swept(totals: Totals, places: int, parts: int, step: int, sample: bool, seat: bool) -> Callable:
    """One pass over a bucket: with ``sample``, keeps the present seats; with ``seat``, seats all customers again, else
    gives the finished bucket and the dishes of frequent words. The first sweep begins with the tables that customers in a row take on average."""
    d, d1 = discounts = totals.discount, totals.parent_discount

    def run(part: int, found: dict[str, list]) -> list[dict]:
        state, (tu, still) = _read_state(found["state"][0][1]), found["self"][0][1]
        if step == 1:
            state["fixed"] = state["fixed"] + still
        h, place, word, ctx, cs, ts, node, w, bc, bt = (state[x] for x in ("h", "place", "word", "ctx", "cs", "ts", "node", "w", "bc", "bt"))
        n, rare = len(h), ctx < 0
        whole = totals.tables[ctx]
        if rare.any():
            names, tables = (np.concatenate(x) for x in zip(*(y for _, y in found["totals"]), strict=True))
            order = np.argsort(names)
            u = state["u"][rare]
            sort, got = np.argsort(u), np.empty(len(u), tables.dtype)
            got[sort] = tables[order][np.searchsorted(names[order], u[sort])]
            whole[rare] = got
        stay = state["still"] + np.where(place >= 0, totals.apart[place], 0).astype(np.int64)
        c1 = np.bincount(word, ts, n).astype(np.int64) + stay
        t1 = np.minimum(state["t1"], c1)
        if sample:
            state["samples"].append((_small(c1), _small(t1), _small(tu)))
            state["sum"], state["bsum"] = state["sum"] + ts, state["bsum"] + bt
        if not seat:
            return _finished(part, state, found["static"][0][1])
        names = np.where(rare, state["u"], ctx).view(np.uint64)
        seed = splitmix(h.view(np.uint64)[word] ^ splitmix((names << np.uint64(8)) + np.uint64(step)))
        roots = splitmix(h.view(np.uint64) ^ splitmix(np.full(n, step, np.uint64)))
        apart = splitmix(~h.view(np.uint64)[node] ^ splitmix((w.astype(np.uint64) << np.uint64(8)) + np.uint64(step)))
        others, chance = np.maximum(whole - ts, 0), totals.parent(totals.head_customers, totals.head_tables)[w]
        rest = np.maximum(tu[node] - bt, 0)
        if step == 1:
            unit = lambda x: (x >> np.uint64(11)).astype(float) / float(1 << 53)
            ts = first_tables(cs, (STRENGTH + d * whole) * totals.parent(c1, t1)[word], d, unit(seed))
            t1 = first_tables(np.bincount(word, ts, n).astype(np.int64) + stay, np.full(n, (STRENGTH + d1 * totals.parent_tables) / (totals.known + 1)), d1, unit(roots))
            bt = first_tables(bc, (STRENGTH + d * tu[node]) * chance, d, unit(apart))
        state["ts"], state["t1"] = reseated(word, cs, ts, t1, others, (totals.total, totals.parent_tables), totals.known, discounts, seed, stay, roots)
        state["bt"] = moved(bc, bt, rest, chance, d, apart)
        return [_row(part, "state", _kept_state(state)), _row(part, "sums", None, 0, _sums(state, places)), *_asked(state, part, parts)]

    return run


def _finished(part: int, state: dict, static: dict) -> list[dict]:
    """All dishes of a bucket with the sums of their tables over the samples, all words with their seats in each, and
    apart the dishes of frequent words."""
    many, samples = static["c"].astype(np.int64), len(state["samples"])
    seats = []
    for k in range(3):
        x = np.ones((len(many), samples), np.int64)
        x[many > 1] = np.stack([s[k] for s in state["samples"]], 1).reshape(-1, samples)
        seats.append(_small(x))
    word, c, ctx = np.repeat(*static["word"]), static["cs"], static["ctx"].astype(np.int64) - 1
    sums, apart = np.full(len(c), samples, np.int64), np.full(len(static["bc"]), samples, np.int64)
    sums[c > 1], apart[static["bc"] > 1] = state["sum"], state["bsum"]
    head = np.repeat(static["place"], np.bincount(word, minlength=len(many))) >= 0
    some = np.flatnonzero(static["place"] >= 0)
    frequent = {"h": static["h"][some], "place": static["place"][some], "c": many[some], "seats": [x[some] for x in seats], "word": _small(np.searchsorted(some, word[head])), "ctx": _small(ctx[head]), "cs": _small(c[head]), "sum": _small(sums[head])}
    kept = {"h": static["h"], "c": static["c"], "seats": seats, "word": _runs(word[~head]), "ctx": (ctx[~head] + 1).astype(np.int16), "u": static["u"], "cs": c[~head], "sum": _small(sums[~head]), "node": static["node"], "w": static["w"], "bc": static["bc"], "bsum": _small(apart)}
    return [_row(part, "bucket", kept), _row(part, "contexts", (kept["h"], kept["c"], seats[2])), _row(part, "heads", frequent)]


class Model:
    """A trained model: its buckets, and what goes to every task."""

    def __init__(self, buckets: DataFrame, n: int, known: int, contexts: dict[int, int], counts: list[int], parts: int, samples: list[Totals], discounts: tuple[float, float]) -> None:
        self.buckets, self.n, self.known, self.contexts, self.counts, self.parts, self.samples, self.discounts = buckets, n, known, contexts, np.array(counts), parts, samples, discounts
        self.backoffs = [x.backoff.tolist() for x in samples]
        self.unknown = [float(x.parent(np.zeros(1), np.zeros(1))[0]) for x in samples]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"buckets": None}  # tasks get the figures only

    def roots(self, seats: list[np.ndarray]) -> np.ndarray:
        """The parent's probability of words, by sample."""
        return np.stack([x.parent(seats[0][:, k].astype(float), seats[1][:, k]) for k, x in enumerate(self.samples)], 1)

    def own(self, cs: np.ndarray, sums: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """What dishes themselves add to the probability in a restaurant, summed over the samples."""
        return np.maximum(len(self.samples) * cs.astype(float) - self.discounts[0] * sums, 0) / (STRENGTH + customers)

    @property
    def words(self) -> DataFrame:
        """(h, c, ctxs, probs, p1): the words, in which frequent contexts they occur and with which probabilities there
        and in the parent, summed over the samples and by sample."""
        backoff, customers = np.array(self.backoffs), self.samples[0].customers

        def rows(bucket: pa.Table) -> pa.Table:
            out = []
            for what, _, x in _contents(bucket):
                word, p1 = x["word"] if what == "heads" else np.repeat(*x["word"]), self.roots(x["seats"])
                ctx = x["ctx"].astype(np.int64) - (what != "heads")
                met = ctx >= 0
                word, ctx = word[met], ctx[met]
                probs = self.own(x["cs"][met], x["sum"][met], customers[ctx]) + (backoff[:, ctx].T * p1[word]).sum(1)
                cuts = np.searchsorted(word, np.arange(1, len(x["h"])))
                shown = x["place"] >= 0 if what == "heads" else _find(np.sort(names), x["h"]) < 0
                table = pa.table({"h": pa.array(x["h"]), "c": pa.array(x["c"].astype(np.int64)), "ctxs": [y.tolist() for y in np.split(ctx.astype(np.int32), cuts)][: len(x["h"])], "probs": [y.tolist() for y in np.split(probs, cuts)][: len(x["h"])], "p1": p1.tolist()}, schema=kind)
                out.append(table.filter(pa.array(shown)))
            return pa.concat_tables(out)

        names = np.array(list(_heads(self.contexts)), np.int64)
        kind = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("ctxs", pa.list_(pa.int32())), ("probs", pa.list_(pa.float64())), ("p1", pa.list_(pa.float64()))])
        return self.buckets.where("what in ('bucket', 'heads')").groupBy("part").applyInArrow(rows, "h long, c long, ctxs array<int>, probs array<double>, p1 array<double>")


def train(documents: DataFrame, sweeps: int = SWEEPS, burn: int = BURN) -> Model:
    """A model of the rows (text, held_out) that are not held out."""
    alone = written(_occurrences(documents), "unigrams")
    n, known = alone.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    often = alone.where((F.col("c") * HEAD >= n) | (F.col("h") == _hash(END))).orderBy(F.desc("c"), "h").collect()  # at most HEAD + 1
    contexts = {h: k for k, h in enumerate(r.h for r in often if r.h != _hash(END))}
    counts = [*(r.c for r in often if r.h != _hash(END)), sum(r.c for r in often if r.h == _hash(END))]
    delete(documents.sparkSession, alone)
    places, parts = len(counts), max(min(BUCKETS, 1 + n // SPARSE), -(-n // BUCKET))
    customers = np.array([*counts, 0])  # the start is the context of as many tokens as there are ends
    rows = _kept(_by_part(_sent(documents, contexts, parts), _built(contexts, counts, parts)), "words")
    static = rows.where("what = 'static'")

    def totals(table: DataFrame, discounts: tuple[float, float] | None) -> Totals:
        sums = np.zeros(4 * places + 7)
        for k, x in table.where("what = 'sums'").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect():
            sums[k] = x
        return Totals(customers, sums, known, discounts)

    now = totals(rows, None)
    discounts, samples, first = (now.discount, now.parent_discount), [], rows
    for step in range(1, sweeps + 2):
        sample, seat = step - 1 > burn, step <= sweeps
        if sample:
            samples.append(now)
        met = rows.where("what = 'state'").unionByName(_by_part(rows.where("what in ('tables', 'own')"), _answered))
        after = _kept(_by_part(met if seat else met.unionByName(static), _swept(now, places, parts, step, sample, seat)), "words")
        if rows is not first:
            delete(documents.sparkSession, rows)
        rows = after
        if seat:
            now = totals(rows, discounts)
    delete(documents.sparkSession, first)
    return Model(rows, n, known, contexts, counts, parts, samples, discounts)


def _known_contexts(part: int, found: dict[str, list]) -> list[dict]:
    """Customers and, by sample, tables of the contexts that the buckets ask for, once for each of these."""
    if "asks" not in found:
        return []
    to, u = (np.concatenate(x) for x in zip(*(y for _, y in found["asks"]), strict=True))
    order = np.argsort(u)
    order = order[_grouping(to[order])]
    to, u = to[order], u[order]
    once = np.concatenate(([True], (to[1:] != to[:-1]) | (u[1:] != u[:-1])))
    to, u = to[once], u[once]
    h, c, tables = found["contexts"][0][1] if "contexts" in found else (np.empty(0, np.int64),) * 3
    at = _find(h, u)
    out = []
    for k, s in _split(to):
        mine = s[at[s] >= 0]
        if len(mine):
            out.append(_row(k, "answers", (u[mine], _small(c[at[mine]]), _small(tables[at[mine]])), part))
    return out


def _looked_up(model: Model) -> Callable:
    """What the tokens of a bucket's dishes add to their texts, by chunk."""
    samples, backoff, width = len(model.samples), np.ascontiguousarray(np.array(model.backoffs).T), len(model.counts) + 1
    customers, unknown, d = model.samples[0].customers, np.array(model.unknown), model.discounts[0]
    tops = np.stack([x.parent(x.head_customers, x.head_tables) for x in model.samples], 1)  # of frequent words
    frequent = np.log10(model.counts + 0.1)
    left = lambda tables, c: (STRENGTH + d * tables) / (STRENGTH + c.astype(float))[:, None]

    def run(part: int, found: dict[str, list]) -> list[dict]:
        none = np.empty(0, np.int64)
        seats = [np.empty((0, samples), np.int64)] * 3
        x = found["bucket"][0][1] if "bucket" in found else {"h": none, "c": none, "seats": seats, "word": (none, none), "ctx": none, "u": none, "cs": none, "sum": none, "node": (none, none), "w": none, "bc": none, "bsum": none}
        # the last row is that of what isn't known
        h, c = x["h"], np.append(x["c"].astype(np.int64), 0)
        p1, leaves = np.vstack((model.roots(x["seats"]), unknown)), np.vstack((left(x["seats"][2], c[:-1]), np.ones(samples)))
        answers = found.get("answers", [])
        names = np.concatenate([none, *(y[0] for _, y in answers)])
        order = np.argsort(names)
        names = names[order]
        met = np.append(np.concatenate([none, *(y[1] for _, y in answers)])[order], 0)
        far = np.vstack((left(np.concatenate([np.empty((0, samples)), *(y[2] for _, y in answers)])[order], met[:-1]), np.ones(samples)))
        word, ctx = np.repeat(*x["word"]), x["ctx"].astype(np.int64) - 1
        rare = ctx < 0
        # as they stand, dishes are in the order of these
        keys = [word[~rare] * width + ctx[~rare], np.repeat(*x["node"]) * width + x["w"], _ranked(word[rare], len(h), x["u"])]
        kept = [(x["cs"][~rare], x["sum"][~rare]), (x["bc"], x["bsum"]), (x["cs"][rare], x["sum"][rare])]
        base = np.log10(c + 0.1)
        out = []
        for chunk, (texts, content) in found.get("tokens", []):
            total = np.zeros((3, texts))
            for kind, (owners, runs, other, size, text, *named) in content.items():
                owner = _find(h, owners)  # -1: the last row
                first, other = np.repeat(owner, runs), other.astype(np.int64)
                if kind == 1:
                    share, root, many = leaves.take(first, 0), tops.take(other, 0), c.take(first)
                    known, log = (model.counts > 0).take(other), frequent.take(other)
                else:
                    known, log, root = (y.take(owner, 0).repeat(runs, 0) for y in (c > 0, base, p1))
                    if kind == 0:
                        share, many = backoff.take(other, 0), customers.take(other)
                    else:
                        at = _find(names, named[0])
                        share, many = far.take(at, 0).take(other, 0), met.take(at).take(other)
                prob = np.einsum("ij,ij->i", share, root)
                if kind == 2:
                    own = named[0].take(other)
                    at = _find_ranked(keys[2], x["u"], _ranked(first, len(h), own), own)
                else:
                    at = _find(keys[kind], first * width + other)
                hit = np.flatnonzero(at >= 0)
                prob[hit] += model.own(kept[kind][0].take(at[hit]), kept[kind][1].take(at[hit]), many.take(hit))
                for k, value in enumerate((known, log, np.log10(prob / samples))):
                    total[k] += np.bincount(text, np.repeat(value.astype(float), size), texts)
            out.append(_row(part, "sums", total, chunk))
        return out

    return run


def _total(table: pa.Table) -> pa.Table:
    """The rows of a chunk's texts, from what each bucket adds."""
    found = {(what, part): x for what, part, x in _contents(table, "part")}
    counts, sums = found["texts", 0]
    for (what, _), x in found.items():
        sums = sums + x if what == "sums" else sums
    own = next(k for k, x in enumerate(zip(table["what"].to_pylist(), table["piece"].to_pylist(), strict=True)) if x == ("texts", 0))
    keys = table["keys"].chunk(0) if table["keys"].num_chunks == 1 else pa.concat_arrays(table["keys"].chunks)
    return pa.table([keys[own].values, pa.array(counts.astype(np.int64)), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["key", "n_tokens", "n_known", "base", "score"])


def scored(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, base (sum of log10(c + 0.1)) and score of every row."""
    kind = documents.schema[key].dataType
    samples, parts, contexts = len(model.samples), model.parts, model.contexts
    heads, start = _heads(contexts), len(contexts)
    backoff, customers = np.array(model.backoffs).reshape(samples, -1), model.samples[0].customers
    # pairs of frequent words
    table = np.tile(np.log10(np.array(model.unknown) @ backoff[:, : start + 1] / samples).astype(np.float32), (start + 1, 1))
    for _, _, x in _contents(model.buckets.where("what = 'heads'").toArrow(), "part"):  # fewer than (HEAD + 1) ** 2 dishes
        if len(x["h"]):
            p = model.roots(x["seats"]) @ backoff[:, : start + 1]
            p[x["word"], x["ctx"]] += model.own(x["cs"], x["sum"], customers[x["ctx"]])
            table[x["place"]] = np.log10(p / samples)
    base, is_known = np.log10(model.counts + 0.1), (model.counts > 0).astype(float)
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, task = shared.value.ravel(), TaskContext.get().partitionId()
        for number, (rows, at, before, counts, hashes, found) in enumerate(_chunks(batches, 0, heads)):
            chunk, texts = task << 24 | number, len(counts)
            word, ctx = found.take(at), np.where(before < 0, start, found.take(before))
            text, near = np.repeat(np.arange(texts, dtype=np.int32), counts), (word >= 0) & (ctx >= 0)
            mine, theirs, here = word[near], ctx[near], text[near]
            sums = np.stack([np.bincount(here, y, texts) for y in (is_known[mine], base[mine], top.take(mine.astype(np.int64) * (start + 1) + theirs).astype(float))])
            out = [_row(0, "texts", (counts, sums), chunk)]
            # of others the texts of a pair, by its dish
            pair, sort = _sorted(_pair(at[~near], before[~near], len(hashes)), len(hashes).bit_length() * 2)
            text = text[~near][sort]
            key, size = _runs(pair)
            del at, before, word, ctx, mine, theirs, here, pair, sort
            order, group, owner, other, before = _dishes(key, hashes, found, start, parts)
            size = size.astype(np.int64)
            first, size = (np.cumsum(size) - size)[order], size[order]
            ends = np.cumsum(size)
            text = _small(text[np.repeat(first - ends + size, size) + np.arange(len(text))])
            ends = np.concatenate(([0], ends))
            content: dict[int, dict] = {}
            asks, where = [], np.empty(len(hashes), np.int32)
            for part, which, s in _cut(group):
                named = []
                if which == 2:  # contexts are named once
                    names = _distinct(before[s])
                    where[names] = np.arange(len(names))
                    named = [hashes[names]]
                    asks.append((part, *named))
                far = where[before[s]] if which == 2 else other[s]
                content.setdefault(part, {})[which] = (*_runs(owner[s]), _small(far), _small(size[s]), text[ends[s.start] : ends[s.stop]], *named)
            out += [_row(part, "tokens", (texts, x), chunk) for part, x in content.items()]
            if asks:
                names, to = np.concatenate([x for _, x in asks]), _small(np.repeat([x for x, _ in asks], [len(x) for _, x in asks]))
                out += [_row(k, "asks", (to[s], names[s]), chunk) for k, s in _split(_part(names, parts))]
            yield from _rows(out, pa.concat_arrays([x.column(1) for x in rows]))

    name = f"{ROW}, keys array<{kind.simpleString()}>"
    buckets, frame = model.buckets.where("what = 'bucket'"), documents.select(F.col(text).alias("text"), F.col(key).alias("key"))
    done = []
    for k in range(SLICES):  # what is sent for all texts at once is too much for the disk
        sent = _kept(through_python(frame.where(F.pmod(F.xxhash64("key", "text"), F.lit(SLICES)) == k), run, name), "tokens")
        rows = sent.drop("keys")
        answers = _by_part(rows.where("what = 'asks'").unionByName(model.buckets.where("what = 'contexts'")), _known_contexts)
        found = _by_part(rows.where("what = 'tokens'").unionByName(buckets).unionByName(answers), _looked_up(model))
        totals = sent.where("what = 'texts'").unionByName(found.withColumn("keys", F.lit(None).cast(f"array<{kind.simpleString()}>")))
        done.append(written(totals.groupBy("chunk").applyInArrow(_total, f"key {kind.simpleString()}, n_tokens long, n_known long, base double, score double"), "scores"))
        delete(documents.sparkSession, sent)
    return reduce(DataFrame.unionByName, done)


def op10(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 10 == 0
    rows = documents.select("doc_id", "text", held.alias("held_out"))
    model = train(rows)
    found = scored(rows, model)
    floor = float(np.log10(model.n + 0.1 * (model.known + 1)))
    return found.select(
        F.col("key").alias("doc_id"), (F.coalesce(F.crc32(F.col("key").cast("string")), F.lit(0)) % 10 == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score",
    )


def perplexity(scores: DataFrame, score: str = "score") -> DataFrame:
    """(held_out, perplexity) from rows as :func:`op10` gives them."""
    return scores.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum(score) / F.sum("n_tokens")).alias("perplexity"))
