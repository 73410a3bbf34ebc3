"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text becomes a lattice whose edges are vocabulary pieces. Forward filtering sums the weight of all paths to each
node; backward sampling draws the last piece of a path in proportion, then the one before it, and so on, so that every
segmentation has exactly its probability. A piece's weight is (its rank + 1) ** -alpha: the vocabulary is in order of
merges, so this is Zipf's law with exponent alpha. Large alpha favours few and frequent pieces.

Draws come from a counter-based generator seeded by the row's key, so a row's segmentation depends on its key, text and parameters
only. The lattice is walked chunk by chunk: where two adjacent characters never occur side by side in any piece,
every path passes between them, so chunks are independent and a chunk's forward sums can be kept for its next use.
A chunk of more than LONG characters is filtered forward with the sums at every LONG-th place kept, and sampled
backward block by block with the sums between worked out again, so its lattice is never held whole.
A character in no piece of its own is spelt by its UTF-8 bytes. So is U+2581, which stands for a space inside pieces.

Defined results: a null or empty text has no pieces and decodes to ''; a null key is a key like any other; equal rows
get equal pieces; a text of any length is encoded whole, with memory for the text and its pieces besides a bounded
part; an empty table gives an empty result; input columns named like an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, by_size, splitmix, through_python, vocabulary

MODEL = "piece_bpe_32k.model"
ALPHA = 1.5
SPACE = "▁"
LITERAL = "\ud800"  # stands for U+2581 in a text; no valid text holds a lone surrogate
KEPT = 300_000  # chunks whose sums a worker keeps
SIEVE = 17  # high bits of a hash by which most stretches are known to be no piece
BATCH = 200_000  # characters of chunks that are filtered at once
HASH = np.uint64(0x9E3779B97F4A7C15)  # base of the rolling hash of pieces
WINDOW = 1 << 20  # characters of a text, or bytes of several, that are worked on at once
LONG = 1 << 15  # characters of a chunk whose lattice is held whole
MASK = (1 << 64) - 1
GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # between the seeds of a text's chunks


class Buffer:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.whole, self.size = np.empty(1 << 16, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.whole):
            grown = np.empty(max(self.size + len(values), len(self.whole) * 3 // 2), self.whole.dtype)
            grown[: self.size] = self.whole[: self.size]
            self.whole = grown
        self.whole[self.size : self.size + len(values)] = values
        self.size += len(values)


class Pieces:
    """Encoder and decoder over the vocabulary of a SentencePiece model file.

    Known chunks have their lattice in flat arrays: a node is an end place in a chunk, ``first`` has the place of its
    first edge, and edges stand together, the widest first, with their cumulative odds in 32 bits in ``odds`` and
    token << 5 | width in ``edges``. Edges are drawn for many chunks at once."""

    def __init__(self, model: str = f"{TOKENIZERS}/{MODEL}", alpha: float = ALPHA) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        ordinary = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        of_bytes = {i: bytes([b]) for b, i in enumerate(self.byte)}
        #: The bytes of each piece in a text; pieces hold U+2581 for spaces only.
        self.raw = [of_bytes.get(i) or p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        by_rank = sorted(ordinary, key=lambda i: (-sp.get_score(i), i))
        self.ids = {self.pieces[i]: (i, (rank + 2.0) ** -alpha) for rank, i in enumerate(by_rank)}
        self.byte_weight = (len(by_rank) + 2.0) ** -alpha
        self.longest = max(map(len, self.ids))
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.spelt: list[tuple[int, ...]] = [(i,) for i in range(size)]  # what an edge's token stands for
        self.spelling: dict[str, int] = {}  # of characters that are spelt by bytes
        # the usual cuts are found by a pattern: before a space that follows another character, and around a newline
        usual = not any(p[1] == SPACE != p[0] for p in self.pairs) and not any("\n" in p for p in self.ids)
        self.split = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+") if usual else re.compile(r"(?s).+")
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in range(2, self.longest + 1):
            own = [p for p in self.ids if len(p) == width]
            codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), width).astype(np.uint64)
            keys = (codes * HASH ** np.arange(width - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            order = np.argsort(keys)
            ids, weights = zip(*(self.ids[p] for p in own), strict=True) if own else ((), ())
            seen = np.zeros(1 << SIEVE, bool)
            seen[keys >> np.uint64(64 - SIEVE)] = True
            self.by_width[width] = keys[order], np.array(ids, np.int32)[order], np.array(weights)[order], seen
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces have one hash")
        if self.longest > 31:
            raise ValueError("a piece is longer than 31 characters")
        self.last_node: dict[str, int] = {}
        self.first, self.odds, self.edges = Buffer(np.int32), Buffer(np.uint32), Buffer(np.int32)

    def _clear(self) -> None:
        self.last_node.clear()
        self.first.size = self.odds.size = self.edges.size = 0

    def forget(self) -> None:
        """Drops what is known of chunks; the vocabulary stays."""
        self.last_node = {}
        self.first, self.odds, self.edges = Buffer(np.int32), Buffer(np.uint32), Buffer(np.int32)

    def _parts(self, chunk: str) -> list[str]:
        """A chunk that is long is split at every place that no piece spans."""
        cuts = [0, *(k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in self.pairs), len(chunk)]
        return [chunk[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _spelling(self, char: str) -> tuple[int, int]:
        """The token that stands for a character's bytes, and their number; of one byte, its own piece."""
        if char < "\x80":
            return self.byte[ord(char)], 1
        token = self.spelling.get(char)
        if token is None:
            token = self.spelling[char] = len(self.spelt)
            self.spelt.append(tuple(self.byte[b] for b in (SPACE if char == LITERAL else char).encode()))
        return token, len(self.spelt[token])

    def _single(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token and weight of each character by itself: its piece, or its bytes."""
        kinds, which = np.unique(codes, return_inverse=True)
        tokens, weights = np.empty(len(kinds), np.int32), np.empty(len(kinds))
        for k, code in enumerate(kinds.tolist()):
            hit = self.ids.get(chr(code))
            if hit is None:
                token, length = self._spelling(chr(code))
                hit = token, self.byte_weight**length
            tokens[k], weights[k] = hit
        return tokens[which].reshape(codes.shape), weights[which].reshape(codes.shape)

    def _learn(self, chunks: list[str]) -> None:
        """Forward filtering of new chunks, all of one length at a time: adds their nodes and edges."""
        by_length: dict[int, list[str]] = {}
        for chunk in chunks:
            by_length.setdefault(len(chunk), []).append(chunk)
        for n, alike in by_length.items():
            for at in range(0, len(alike), step := max(1, BATCH // n)):
                self._filter(alike[at : at + step], n)

    def _lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token and weight of the pieces in rows of code points, by end and width - 1; weight 0: no piece."""
        many, n = codes.shape
        most = min(n, self.longest)
        token, weight = np.zeros((many, n, most), np.int32), np.zeros((many, n, most))
        token[:, :, 0], weight[:, :, 0] = self._single(codes)
        hashed = codes.astype(np.uint64)
        for width in range(2, most + 1):
            hashed = hashed[:, 1:] + codes[:, : n - width + 1].astype(np.uint64) * HASH ** np.uint64(width - 1)
            keys, ids, weights, seen = self.by_width[width]
            if len(keys):
                row, col = np.nonzero(seen[hashed >> np.uint64(64 - SIEVE)])  # most are no piece's
                wanted = hashed[row, col]
                which = np.searchsorted(keys, wanted)
                which[which == len(keys)] = 0
                real = keys[which] == wanted
                row, col, which = row[real], col[real], which[real]
                token[row, col + width - 1, width - 1] = ids[which]
                weight[row, col + width - 1, width - 1] = weights[which]
        return token, weight

    def _filter(self, chunks: list[str], n: int) -> None:
        many, most = len(chunks), min(n, self.longest)
        token, weight = self._lattice(_codes("".join(chunks)).reshape(many, n))
        sums, upto = np.ones((many, n + 1)), np.zeros((many, n, most))  # upto: by end and most - width
        for end in range(1, n + 1):
            reach = min(end, most)
            np.cumsum(weight[:, end - 1, reach - 1 :: -1] * sums[:, end - reach : end], axis=1, out=upto[:, end - 1, most - reach :])
            total = upto[:, end - 1, -1].copy()
            upto[:, end - 1] /= total[:, None]
            if total.min() < 1e-100:  # long chunks: lift the sums that are still in use
                lift = np.where(total < 1e-100, 1e100, 1.0)
                sums[:, max(0, end - most + 1) : end] *= lift[:, None]
                total *= lift
            sums[:, end] = total
        real = weight[:, :, ::-1] > 0
        width = np.broadcast_to(np.arange(most, 0, -1, dtype=np.int32), real.shape)[real]
        count = real.sum(axis=2)
        last = np.cumsum(count) - 1
        odds = np.minimum(upto[real] * 4294967296.0, 4294967295.0).astype(np.uint32)
        odds[last] = 0xFFFFFFFF
        first = np.zeros((many, n + 1), np.int64)  # a chunk's node 0 has no edges
        first[:, 1:] = self.odds.size + (last + 1).reshape(many, n) - count
        node = self.first.size + np.arange(many) * (n + 1) + n
        self.last_node.update(zip(chunks, node.tolist(), strict=True))
        self.first.extend(first.ravel().astype(np.int32))
        self.odds.extend(odds)
        self.edges.extend(token[:, :, ::-1][real] << 5 | width)

    def _sampled(self, chunks: list[str], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of every chunk: tokens in order, and how many each chunk has."""
        if len(self.last_node) > KEPT:
            self._clear()
        known = self.last_node
        if new := list({c for c in chunks if c not in known}):
            self._learn(new)
        first, odds, edges = self.first.whole, self.odds.whole, self.edges.whole
        node = np.fromiter(map(known.__getitem__, chunks), np.int32, len(chunks))
        left = np.fromiter(map(len, chunks), np.int32, len(chunks))
        live, steps, taken = np.arange(len(chunks)), np.zeros(len(chunks), np.int64), []
        while live.size:
            draws = splitmix(draws)
            wanted = (draws >> np.uint64(32)).astype(np.uint32)
            edge = first[node]
            on = np.flatnonzero(wanted > odds[edge])
            while on.size:  # the last edge of a node is always enough
                edge[on] += 1
                on = on[wanted[on] > odds[edge[on]]]
            drawn = edges[edge]
            width = drawn & 31
            taken.append((live, drawn >> 5))
            steps[live] += 1
            left = left - width
            more = np.flatnonzero(left)
            live, left, node, draws = live[more], left[more], (node - width)[more], draws[more]
        ends = np.cumsum(steps)
        tokens = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for step, (which, token) in enumerate(taken):
            tokens[ends[which] - 1 - step] = token
        return tokens, steps

    def _block(self, chunk: str, low: int, sums: list[float]) -> tuple[list[int], list[int], list[float]]:
        """Edges of the block of a long chunk that begins at ``low``, by end: (place of each end's first edge, edges as
        token << 5 | width, cumulative odds). ``sums``: those before the block, to which its own are added."""
        high, context = min(len(chunk), low + LONG), len(sums) - 1
        token, weight = (x[0, context:, ::-1] for x in self._lattice(_codes(chunk[low - context : high])[None, :]))
        end, at = np.nonzero(weight)
        width = weight.shape[1] - at
        edges, weights = (token[end, at] << 5 | width).tolist(), weight[end, at].tolist()
        firsts = np.searchsorted(end, np.arange(high - low + 1)).tolist()
        width, odds = width.tolist(), []
        for k in range(high - low):
            total, size = 0.0, len(sums)
            for e in range(firsts[k], firsts[k + 1]):
                total += weights[e] * sums[size - width[e]]
                odds.append(total)
            for e in range(firsts[k], firsts[k + 1]):
                odds[e] /= total
            if total < 1e-100:
                sums[-self.longest :] = [x * 1e100 for x in sums[-self.longest :]]
                total *= 1e100
            sums.append(total)
        return firsts, edges, odds

    def _long(self, chunk: str, draw: int) -> np.ndarray:
        """The sampled tokens of a chunk whose lattice is too long to be held."""
        kept, sums = [], [1.0]
        for low in range(0, len(chunk), LONG):
            kept.append(sums[-self.longest :])
            sums = sums[-self.longest :]
            self._block(chunk, low, sums)
        at, parts = len(chunk), []
        for low in range(LONG * (len(kept) - 1), -1, -LONG):
            firsts, edges, odds = self._block(chunk, low, kept.pop())
            tokens = []
            while at > low:
                draw = _next(draw)
                want, e, last = (draw >> 32) / 4294967296.0, firsts[at - low - 1], firsts[at - low] - 1
                while e < last and want >= odds[e]:
                    e += 1
                tokens.append(edges[e] >> 5)
                at -= edges[e] & 31
            parts.append(np.array(tokens[::-1], np.int32))
        return np.concatenate(parts[::-1])

    def _windows(self, body: str) -> Iterator[str]:
        """A text, spaces as U+2581, in stretches of WINDOW characters or somewhat more, cut where no piece goes over."""
        at, cut = 0, WINDOW
        while cut < len(body):
            if body[cut - 1 : cut + 1] in self.pairs:
                cut += 1
                continue
            yield body[at:cut]
            at, cut = cut, cut + WINDOW
        yield body[at:]

    def encode_all(self, texts: list[str], keys: list, seed: int = 0) -> list[np.ndarray]:
        """A sampled segmentation of each text, as piece ids."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        chunks: list[str] = []
        owners: list[tuple[int, int, int]] = []  # (text, first chunk's place in it, chunks)

        def flush() -> None:
            nonlocal chunks, owners
            if not chunks:
                return
            draws = np.concatenate([np.uint64(starts[t]) + np.arange(k, k + n, dtype=np.uint64) * GOLDEN for t, k, n in owners])
            tokens, steps = self._sampled(chunks, draws)
            ends, at, begin = np.cumsum(steps), 0, 0
            for t, _, n in owners:
                at += n
                end = int(ends[at - 1])
                out[t].append(self._unfolded(tokens[begin:end]))
                begin = end
            chunks, owners = [], []

        starts = [xxhash.xxh64_intdigest(f"{seed}:{key}", 42) for key in keys]
        for t, text in enumerate(texts):
            place = 0
            for window in self._windows(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else ():
                found = self.split.findall(window)
                if max(map(len, found)) > 64:
                    found = [p for c in found for p in (self._parts(c) if len(c) > 64 else (c,))]
                begin = 0
                for k in [k for k, c in enumerate(found) if len(c) > LONG] if len(window) > LONG else ():
                    if k > begin:
                        chunks += found[begin:k]
                        owners.append((t, place + begin, k - begin))
                    flush()
                    out[t].append(self._unfolded(self._long(found[k], (starts[t] + (place + k) * int(GOLDEN)) & MASK)))
                    begin = k + 1
                if begin < len(found):
                    chunks += found[begin:]
                    owners.append((t, place + begin, len(found) - begin))
                place += len(found)
                if len(chunks) > 300_000:
                    flush()
        flush()
        return [np.concatenate(x) if x else np.empty(0, np.int32) for x in out]

    def _unfolded(self, ids: np.ndarray) -> np.ndarray:
        """Tokens with characters that are spelt by bytes written out."""
        if not len(ids) or ids.max() < len(self.pieces):
            return ids
        return np.fromiter((x for i in ids.tolist() for x in self.spelt[i]), np.int32)

    def encode(self, text: str, key: object = None, seed: int = 0) -> list[int]:
        return self.encode_all([text], [key], seed)[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded."""
        return b"".join(map(self.raw.__getitem__, ids)).decode()[1:]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _next(x: int) -> int:
    """:func:`splitmix` of one counter."""
    x = x + 0x9E3779B97F4A7C15 & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


_loaded: dict[tuple[str, float], Pieces] = {}


def loaded(model: str, alpha: float) -> Pieces:
    """One encoder a worker."""
    if (model, alpha) not in _loaded:
        _loaded[model, alpha] = Pieces(model, alpha)
    return _loaded[model, alpha]


def digest(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<i4").tobytes())


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0, model: str | None = None, alpha: float = ALPHA, whole_ids: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, piece_ids, pieces_crc, n_pieces, lossless): pieces_crc is the CRC-32 of the ids as 4-byte little-endian
    integers, lossless whether the decoded pieces are the text. Without ``whole_ids``, piece_ids is left out; the columns in ``more``
    come along. ``model`` is the path of a vocabulary other than the usual one."""
    model = model or vocabulary(df.sparkSession, MODEL)
    kind = df.schema[key].dataType.simpleString()
    names = ["key", *["piece_ids"] * whole_ids, "pieces_crc", "n_pieces", "lossless", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(model, alpha)
        for whole in batches:
            for batch in by_size(whole, 1, WINDOW):
                texts = [x or "" for x in batch.column(1).to_pylist()]
                ids = coder.encode_all(texts, batch.column(0).to_pylist(), seed)
                same = [coder.decode(i.tolist()) == x for i, x in zip(ids, texts, strict=True)]
                columns = [batch.column(0), *[pa.array(ids, pa.list_(pa.int32()))] * whole_ids, pa.array(map(digest, ids), pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(same, pa.bool_()), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        coder.forget()

    kinds = f"key {kind}, " + "piece_ids array<int>, " * whole_ids + "pieces_crc long, n_pieces long, lossless boolean" + "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in more)
    return through_python(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *more), run, kinds)


def decoded(df: DataFrame, ids: str = "piece_ids", model: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """The rows with ``decoded``, the text of their piece ids; null ids decode to ''."""
    model = model or vocabulary(df.sparkSession, MODEL)

    @F.pandas_udf("string")
    def text(column):  # noqa: ANN001, ANN202
        coder = loaded(model, alpha)
        return column.map(lambda x: coder.decode(list(x)) if x is not None and len(x) else "")

    return df.withColumn("decoded", text(F.col(ids)))


def op2(documents: DataFrame) -> DataFrame:
    """doc_id, n_pieces, pieces_crc and lossless of every document."""
    return encoded(documents, whole_ids=False).withColumnRenamed("key", "doc_id").select("doc_id", "n_pieces", "pieces_crc", "lossless")
