"""Packing by concatenating and cutting.

All documents stand one after another, each as its token ids and a closing id, and the stream is cut into windows of
equal width, so only its last sequence can be short. No document's place needs an order of all documents:

1. The first pass tokenizes. Each task writes its documents with their ids and the ids that the task's own documents had
   before them. The tasks' totals, one number a task, are summed up in the order of the tasks: the task's place in the
   stream.
2. The second pass reads that table, adds the task's place to each document's, and cuts at the multiples of the width. A
   document that lies across a cut gives a piece on either side, each with its sequence and its place there; these pieces
   are the boundary records by which windows that span documents, tasks and files are put together again.

No row is shuffled. The table keeps the places, so they stay the same when a lost executor's tasks run again.

Texts are cut where the vocabulary's pattern always begins a pre-token: at a single space between two characters that are
no white space, and at a line feed between such. What lies between two cuts is encoded once and looked up for its next use.

Defined results: a null or empty text has the closing id alone; rows that are equal, or share an id or have none, are
packed apart; an empty table gives an empty result; only the columns named are read, so others may have any name. Very
long texts are tokenized whole, one at a time, and handed on in bounded batches of pieces.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, through_python, vocabulary, written
from .tokencount import PATTERN

VOCABULARY = "byte_bpe_50k.json"
WIDTH = 1024
END = 0
KEPT = 500_000  # stretches whose ids a worker keeps
SPACE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """The ids of texts, over the stretches between cuts that it has met.

    A stretch is known by its text without the space in front. One that begins with a line feed has no space in front,
    nor has one behind a zero character, which marks a text's first stretch and those that begin or end in white space."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.added = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.odd = ["\0", "\n ", "\n\n\n", *self.added]
        self.merges, self.begins = _merges(path)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}  # 0: not a stretch of its own
        self.first, self.many = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.empty(0, np.int32)

    def stretches(self, text: str) -> list[str]:
        """Cut at single spaces and at one or two line feeds. Some may turn out to be none when they are learned."""
        spaced = text.replace("\n", " \n")
        if "  " in spaced or spaced[:1] in ("", " ") or text.endswith((" ", "\n\n")) or any(x in text for x in self.odd):
            return self.safe(text)
        parts = spaced.split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    @staticmethod
    def safe(text: str) -> list[str]:
        """Cut at single spaces between characters that are no white space."""
        if not text:
            return []
        parts = SPACE.split(text)
        return ["\0" + parts[0], *[x if _clean(x) else "\0 " + x for x in parts[1:]]]

    def _learn(self, found: list[str]) -> None:
        spaced, lined, alone = [], [], []
        joined = "".join(found)
        odd = " " in joined or any(t in joined for t in self.added)  # else no stretch is
        for x in found:
            first = x[0]
            if first == "\0":
                alone.append(x)
            elif first == "\n":
                if x == "\n":
                    alone.append(x)
                elif _clean(x[1:]):
                    lined.append(x)
                else:
                    self.place[x] = 0
            elif first.isspace() or x[-1].isspace():
                self.place[x] = 0
            elif odd and (" " in x or any(t in x for t in self.added)):
                alone.append(x)
            else:
                spaced.append(x)
        kinds = {" ": spaced, "\n": [x for x in lined if not (odd and any(t in x for t in self.added))], "": alone}
        if odd:
            alone += [x for x in lined if any(t in x for t in self.added)]
        for lead, new in kinds.items():
            if new:
                whole = [x[1:] if x[0] == "\0" else x if x[0] == "\n" else " " + x for x in new]
                ids, many = self._joined(whole, lead) if lead and self.merges else self._single(whole)
                self.place |= zip(new, range(len(self.many), len(self.many) + len(new)), strict=True)
                self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(many) - many))
                self.many = np.concatenate((self.many, many))
                self.ids = np.concatenate((self.ids, ids))

    def _single(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.own.encode_batch_fast(texts, add_special_tokens=False)]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(many.sum())), many

    def _joined(self, texts: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """All in one text: each begins where a token begins with its first character, which none has further on."""
        ids = np.array(self.merges.encode_ordinary("".join(texts)), np.int32)
        at = np.flatnonzero(self.begins[lead][ids])
        assert len(at) == len(texts)
        return ids, np.diff(at, append=len(ids))

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.place) > KEPT:
            self._clear()
        lists = list(map(self.stretches, texts))
        at = self._places(lists)
        if not at.all():
            owner = np.repeat(np.arange(len(lists)), list(map(len, lists)))
            for k in np.unique(owner[at == 0]).tolist():
                lists[k] = self.safe(texts[k])
            at = self._places(lists)
        many = self.many[at]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.first[at] - (ends - many), many)]
        stops = np.concatenate(([0], ends))[np.cumsum(list(map(len, lists)))] if lists else np.empty(0, np.int64)
        return np.split(ids, stops[:-1]) if lists else []

    def _places(self, lists: list[list[str]]) -> np.ndarray:
        flat = list(chain.from_iterable(lists))
        at = np.fromiter(map(self.place.get, flat, repeat(-1)), np.int64, len(flat))
        if len(holes := np.flatnonzero(at < 0)):
            new = [flat[k] for k in holes.tolist()]
            self._learn(list(dict.fromkeys(new)))
            at[holes] = [self.place[x] for x in new]
        return at


def _merges(path: str) -> tuple[object, dict[str, np.ndarray]]:
    """The same byte-level vocabulary for the library that merges faster, and which tokens begin with a space or a line
    feed; nothing for vocabularies of another kind. Its ids are in the order of the merges, so they are its ranks."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    if made["model"].get("type", "BPE") != "BPE" or (made["pre_tokenizer"] or {}).get("type") != "ByteLevel" or made["pre_tokenizer"]["add_prefix_space"] or made["normalizer"]:
        return None, {}
    import tiktoken

    # bytes that print stand for themselves, the others for the characters from 256 on
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(prints)))}
    added = {t["content"] for t in made["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): rank for token, rank in made["model"]["vocab"].items() if token not in added}
    begins = {lead: np.zeros(max(ranks.values()) + 1, bool) for lead in " \n"}
    for token, rank in ranks.items():
        if token[:1] in (b" ", b"\n"):
            begins[token[:1].decode()][rank] = True
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), begins


def _clean(part: str) -> bool:
    """Neither begins nor ends in white space, nor has the mark."""
    return not (part[0].isspace() or part[-1].isspace() or part[0] == "\0")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(documents: DataFrame, key: str, text: str, path: str, end: int = END) -> DataFrame:
    """(key, part, before, n, ids) of each document: the task that has it, the ids of the task before it, its own ids with
    the closing one, as little-endian 32-bit integers."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in by_size(whole, 1, 1 << 20):
                found = [np.append(x, end).astype("<u4") for x in own.encoded([x or "" for x in batch.column(1).to_pylist()])]
                n = np.array([len(x) for x in found], np.int64)
                places = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(places), pa.array(n), pa.array([x.tobytes() for x in found], pa.binary())], names=["key", "part", "before", "n", "ids"]
                )

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return through_python(rows, run, f"key {kind}, part int, before long, n long, ids binary")


def pieces(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, end: int = END, path: str | None = None) -> DataFrame:
    """(key, start, length, n, sequence_id, offset, ids) of each piece: its place in its document, which has n ids, and in
    its sequence; ids are little-endian 32-bit integers."""
    path = path or vocabulary(documents.sparkSession, VOCABULARY)
    kind = documents.schema[key].dataType.simpleString()
    rows = written(tokenized(documents, key, text, path, end), "tokens", **{"parquet.block.size": 16 << 20})
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a number a task
    place, at = {}, 0
    for part, n in totals:
        place[part], at = at, at + n
    places = documents.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places.value
        for whole in batches:
            for batch in by_size(whole, 4, 1 << 20):
                n = batch.column(3).to_numpy()
                begin = batch.column(2).to_numpy() + np.array([place[p] for p in batch.column(1).to_pylist()], np.int64)
                first = begin // width
                many = (begin + n - 1) // width - first + 1
                row = np.repeat(np.arange(len(n)), many)
                sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                low = np.maximum(begin[row], sequence * width)
                length = np.minimum(begin[row] + n[row], (sequence + 1) * width) - low
                start = low - begin[row]
                bodies = [memoryview(x.as_buffer()) for x in batch.column(4)]
                ids = [bodies[r][4 * a : 4 * (a + m)] for r, a, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), *map(pa.array, (start, length, n[row], sequence, low - sequence * width)), pa.array(ids, pa.binary())], names=["key", "start", "length", "n", "sequence_id", "offset", "ids"]
                )
                yield from by_size(out, 6, 4 << 20)

    return through_python(rows, run, f"key {kind}, start long, length long, n long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n, ids, keys, offsets) of each sequence, put together from its pieces: at most the width of ids, and
    where in it which document's piece begins. A sequence has at most as many pieces as ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "key", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n"),
        F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"),
        F.transform("p", lambda x: x["key"]).alias("keys"),
        F.transform("p", lambda x: x["offset"]).alias("offsets"),
    )


def op13(documents: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece."""
    found = pieces(documents)
    return found.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
