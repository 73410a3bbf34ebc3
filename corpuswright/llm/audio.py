"""Chroma audio fingerprints of a media column, and alignment of recordings.

A recording becomes frames of energy in the twelve pitch classes. Sixteen filters compare two areas of that picture,
each by four reads of its integral image, at every frame; a filter's value is one of four levels in Gray code, and the
sixteen make a 32-bit integer per frame. Two recordings align at an offset where at most MOST_ERRORS of the bits of
their overlap differ, over LEAST_FRAMES or more.

Since an eighth of the bits may differ, candidates need no equal integers: an anchor is KEY_BITS bits sampled by rule
from SPAN successive integers, in each of TABLES samples. Of an indexed recording every STEP-th frame has anchors, of
one that asks every frame, so any offset is met. Equal anchors vote for an offset; every offset with a vote is judged
by its bit errors, and the best is returned. Anchors that agree beside each other, in the frame before or the table
before, vote once: a vote that one of these has cast already is left out, so that two like recordings meet a few times
and not once per frame and table. Inside a run of equal anchors of one recording its ends stand for it. An
anchor shared by very many recordings is dealt over tiles of at most about TILE rows a side, so that no task holds it
whole, and none is capped.

Recordings with equal integers are one class, named by its smallest key; classes are aligned, not their members.

Defined results: a null, empty or unreadable recording (no PCM WAV, no sampling rate, samples that are not 1 to 4 bytes
wide) has no frames, and all such are one class that aligns with nothing; so are recordings too short for one integer;
a null key takes part and comes last; repeated rows are members of one class; a long recording is worked on in windows;
only the two columns named are read, so others may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import splitmix, written

WINDOW_S, HOP_S = 0.5, 0.08
SPAN, KEY_BITS, FINE_BITS, TABLES, STEP = 30, 42, 14, 20, 5
TILE = 512  # anchors of a side that a task meets at once
HELD = 1 << 17  # votes a task sums up before it passes them on
MOST_ERRORS = 0.12  # share of differing bits
LEAST_FRAMES = 54
LEVELS = (-0.25, 0.0, 0.25)
#: (kind, lowest pitch class, classes, frames) of each filter, by rule: kinds in turn, wider in time every fourth.
FILTERS = [(k % 4, 3 * k % 12, 4 + 2 * (k % 3), 4 + 4 * (k // 4)) for k in range(16)]
REACH = max(f[3] for f in FILTERS)


def _sampled(draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(frame in the span, bit of its integer) of each bit of an anchor, spread evenly over the frames. A filter's upper
    bit says which area is louder, its lower (fine) bit how clearly; two thirds are upper bits, as noise turns fewer."""
    upper = np.concatenate([2 * draw.permutation(16) + 1 for _ in range(-(-KEY_BITS // 16))])[: KEY_BITS - FINE_BITS]
    return draw.permutation(np.arange(KEY_BITS) * SPAN // KEY_BITS), draw.permutation(np.concatenate((2 * draw.permutation(16)[:FINE_BITS], upper)))


_draw = np.random.default_rng(7)
SAMPLED = [_sampled(_draw) for _ in range(TABLES)]


def samples(recording: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a PCM WAV file; none if it can't be read."""
    try:
        with wave.open(io.BytesIO(recording or b"")) as file:
            rate, width, channels = file.getframerate(), file.getsampwidth(), file.getnchannels()
            raw = file.readframes(file.getnframes())
    except (wave.Error, EOFError):
        return np.empty(0), 1
    if rate <= 0 or not 1 <= width <= 4:
        return np.empty(0), 1
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 3:
        spread = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        values = ((spread[:, 0] << 8 | spread[:, 1] << 16 | spread[:, 2] << 24) >> 8).astype(float) / (1 << 23)
    else:
        values = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(float)
        values = (values - 128) / 128 if width == 1 else values / (1 << 8 * width - 1)
    return values.reshape(-1, channels).mean(axis=1), rate


def chroma(values: np.ndarray, rate: int) -> np.ndarray:
    """Frames by pitch classes; every frame with sound has length 1."""
    size, hop = max(8, int(rate * WINDOW_S)), max(1, int(rate * HOP_S))
    if len(values) < size:
        return np.empty((0, 12))
    hertz = np.fft.rfftfreq(size, 1 / rate)
    heard = (hertz >= 55) & (hertz <= 3520)
    classes = np.zeros((int(heard.sum()), 12))
    classes[np.arange(len(classes)), np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % 12] = 1
    frames, taper = np.lib.stride_tricks.sliding_window_view(values, size)[::hop], np.hanning(size)
    out = [np.abs(np.fft.rfft(frames[at : at + 64] * taper, axis=1)[:, heard]) ** 2 @ classes for at in range(0, len(frames), 64)]
    picture = np.concatenate(out)
    length = np.linalg.norm(picture, axis=1, keepdims=True)
    return np.divide(picture, length, out=np.zeros_like(picture), where=length > 1e-9)


def integers(picture: np.ndarray) -> np.ndarray:
    """A packed integer for each frame from which all filters reach."""
    n = len(picture) - REACH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    turned = np.concatenate((picture, picture), axis=1)  # pitch classes go round
    total = np.zeros((len(picture) + 1, 25))
    total[1:, 1:] = turned.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(a: int, b: int, low: int, high: int) -> np.ndarray:
        return total[at + b, high] - total[at + a, high] - total[at + b, low] + total[at + a, low]

    out = np.zeros(n, np.uint32)
    for kind, low, high, width in ((k, y, y + h, w) for k, y, h, w in FILTERS):
        mid, half = (low + high) // 2, width // 2
        whole = area(0, width, low, high)
        if kind == 0:
            one = area(0, width, low, mid)
        elif kind == 1:
            one = area(0, half, low, high)
        elif kind == 2:
            one = area(0, half, low, mid) + area(half, width, mid, high)
        else:
            one = area(width // 4, width - width // 4, low, high)
        level = np.digitize(np.log((1 + np.maximum(one, 0)) / (1 + np.maximum(whole - one, 0))), LEVELS).astype(np.uint32)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def anchors(codes: np.ndarray, step: int = 1) -> tuple[np.ndarray, ...]:
    """For every ``step``-th frame of a recording's integers and every table: the anchor, its frame, and marks of the
    anchors STEP frames before and one table before; where those are absent a mark that differs between the sides."""
    at, lag = np.arange(0, len(codes) - SPAN + 1, step), STEP // step
    bits = np.unpackbits(codes.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    keys, stay = np.zeros((TABLES, len(at)), np.int64), np.ones((TABLES, len(at)), bool)
    for table, (frame, bit) in enumerate(SAMPLED if len(at) else ()):
        packed = np.packbits(np.pad(bits[at[:, None] + frame, bit], ((0, 0), (0, 64 - KEY_BITS))), axis=1, bitorder="little")
        keys[table] = packed.view(np.int64)[:, 0] | table << KEY_BITS
    stay[:, lag:-lag] = (keys[:, lag:-lag] != keys[:, : -2 * lag]) | (keys[:, lag:-lag] != keys[:, 2 * lag :])
    marks = np.where(stay, (splitmix(keys.view(np.uint64)) >> np.uint64(33)).astype(np.int32), -step)
    before, above = np.full_like(marks, -step), np.full_like(marks, -step)
    before[:, lag:], above[1:] = marks[:, :-lag], marks[:-1]
    return keys[stay], np.broadcast_to(at.astype(np.int32), keys.shape)[stay], before[stay], above[stay]


def fingerprints(df: DataFrame, key: str, audio: str) -> DataFrame:
    """(key, codes, sign): sign is a hash of the codes."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                codes = [integers(chroma(*samples(x))) for x in batch.column(1).to_pylist()]
                signs = [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in codes]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int32) for x in codes], pa.list_(pa.int32())), pa.array(signs, pa.int64())], names=["key", "codes", "sign"])

    return df.select(F.col(key).alias("key"), F.col(audio).alias("audio")).mapInArrow(run, f"key {kind}, codes array<int>, sign long")


def _anchored(classes: DataFrame, side: int) -> DataFrame:
    """(anchor, side, sign, frame, before, above) of the classes (sign, codes): side 0 asks, side 1 is the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [anchors(np.array(x, np.int32).view(np.uint32), STEP if side else 1) for x in batch.column(1).to_pylist()]
                key, frame, before, above = (np.concatenate([x[k] for x in found]) for k in range(4))
                signs = np.repeat(batch.column(0).to_numpy(), [len(x[0]) for x in found])
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (key, np.full(len(key), side, np.int8), signs, frame, before, above))), names=["anchor", "side", "sign", "frame", "before", "above"])

    return classes.select("sign", "codes").mapInArrow(run, "anchor long, side byte, sign long, frame int, before int, above int")


def _summed(rows: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (q, s, offset) with the sums of their votes."""
    order = np.lexsort(rows.T)
    rows, votes = rows[order], votes[order]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
    return rows[first], np.add.reduceat(votes, first)


def _ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_anchored` with their tile, in order of anchor, tile and side; out: (q, s, offset, votes), summed
    over the task's anchors."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rest: list[pa.RecordBatch] = []

    def passed() -> pa.RecordBatch:
        rows, votes = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(2)), pa.array(rows[:, 2].astype(np.int32)), pa.array(votes)], names=["q", "s", "offset", "votes"])

    def met(frame: pa.Table) -> None:
        anchor, tile, side, sign, at, before, above = (frame.column(c).to_numpy() for c in ("anchor", "tile", "side", "sign", "frame", "before", "above"))
        begin = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1]))))
        many = np.diff(np.append(begin, len(anchor)))
        asks = many - np.add.reduceat(side.astype(np.int64), begin)  # rows of side 0, which come first in a tile
        group = np.repeat(np.arange(len(begin)), many)
        left = np.flatnonzero(side == 0)
        others = (many - asks)[group[left]]
        left, others = left[others > 0], others[others > 0]
        ends = np.cumsum(others)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, HELD):  # some HELD pairs at a time
            part = slice(*np.searchsorted(ends, (lo, lo + HELD), side="right"))
            own, n = left[part], others[part]
            i = np.repeat(own, n)
            j = np.repeat((begin + asks)[group[own]], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            new = (sign[i] != sign[j]) & (before[i] != before[j]) & (above[i] != above[j])
            i, j = i[new], j[new]
            if len(i):
                held.append(_summed(np.stack((sign[i], sign[j], at[j].astype(np.int64) - at[i]), axis=1), np.ones(len(i), np.int64)))

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if sum(x.num_rows for x in rest) < 50_000:
            continue
        frame = pa.Table.from_batches(rest)
        anchor, tile = frame.column("anchor").to_numpy(), frame.column("tile").to_numpy()
        cut = np.flatnonzero((anchor != anchor[-1]) | (tile != tile[-1]))
        if len(cut):  # the last tile may go on
            met(frame.slice(0, int(cut[-1]) + 1))
            rest = frame.slice(int(cut[-1]) + 1).to_batches()
        if sum(len(x) for x, _ in held) > HELD:
            yield passed()
    if rest:
        met(pa.Table.from_batches(rest))
    if held:
        yield passed()


def bit_errors(a: Column, b: Column, offset: Column) -> Column:
    """Share of differing bits of the overlap when frame x of a stands over frame x + offset of b."""
    begin_a, begin_b = F.greatest(-offset, F.lit(0)), F.greatest(offset, F.lit(0))
    n = F.least(F.size(a) - begin_a, F.size(b) - begin_b)
    errors = F.zip_with(F.slice(a, begin_a + 1, n), F.slice(b, begin_b + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))  # the count is of 64 bits, sign and all
    return F.struct(n.alias("frames"), (F.aggregate(errors, F.lit(0), lambda s, x: s + x) / (32 * n)).alias("errors"))


def aligned(df: DataFrame, key: str, audio: str, queries: Column, most: float = MOST_ERRORS, least: int = LEAST_FRAMES) -> tuple[DataFrame, DataFrame]:
    """(members, pairs). members: key, class_id, n_codes. pairs: for each class with a query (``queries`` is a condition
    on the key) the other classes that align with it: query_class, match_class, offset, votes, frames, errors."""
    prints = written(fingerprints(df, key, audio), "prints")
    classes = prints.groupBy("sign").agg(F.min("key").alias("class_id"), F.max(queries).alias("asks"), F.first("codes").alias("codes"))
    classes = written(classes, "classes")
    # an unreadable recording has no codes; the class named null stands for rows without a key
    members = prints.select("key", "sign", F.size("codes").alias("n_codes")).join(classes.select("sign", "class_id"), "sign").drop("sign")
    asked = written(_anchored(classes.where("asks"), 0), "asked")
    # most anchors of the index meet none that is asked for: they are left before anything is sorted
    wanted = asked.select("anchor").distinct().hint("shuffle_hash")
    index = written(_anchored(classes, 1).join(wanted, "anchor", "left_semi"), "index")
    anchored = asked.unionByName(index)
    slices = lambda side: F.ceil(F.count_if(F.col("side") == side) / F.lit(float(TILE))).cast("int")
    # an anchor of more rows than a tile is dealt over slices of both sides, and each pair of slices is a tile
    hot = anchored.groupBy("anchor").agg(slices(0).alias("across"), slices(1).alias("down")).where("across > 0 and (across > 1 or down > 1)")
    hot = written(hot, "hot")
    own, other = F.when(F.col("side") == 0, F.col("across")).otherwise(F.col("down")), F.when(F.col("side") == 0, F.col("down")).otherwise(F.col("across"))
    mine, theirs = F.coalesce(F.pmod(F.xxhash64("sign", "frame"), own), F.lit(0)), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)).cast("long") - 1))
    dealt = anchored.join(hot, "anchor", "left").withColumns({"_mine": mine.cast("long"), "_theirs": theirs})
    tile = F.when(F.col("side") == 0, F.shiftleft("_mine", 32) + F.col("_theirs")).otherwise(F.shiftleft("_theirs", 32) + F.col("_mine"))
    rows = dealt.select("anchor", tile.alias("tile"), "side", "sign", "frame", "before", "above").repartition("anchor", "tile").sortWithinPartitions("anchor", "tile", "side")
    votes = rows.mapInArrow(_ballots, "q long, s long, offset int, votes long").repartition("q", "s").groupBy("q", "s", "offset").agg(F.sum("votes").alias("votes"))
    histogram = votes.groupBy("q", "s").agg(F.collect_list(F.struct("votes", "offset")).alias("offsets"))  # at most the offsets of two recordings
    left = classes.select(F.col("sign").alias("q"), F.col("class_id").alias("query_class"), F.col("codes").alias("a"))
    right = classes.select(F.col("sign").alias("s"), F.col("class_id").alias("match_class"), F.col("codes").alias("b"))
    judged = F.transform("offsets", lambda o: F.struct(bit_errors(F.col("a"), F.col("b"), o["offset"]).alias("z"), o["votes"].alias("votes"), o["offset"].alias("offset")))
    fit = F.filter(judged, lambda x: (x["z"]["frames"] >= least) & (x["z"]["errors"] <= most))
    order = lambda x: F.struct(x["z"]["errors"], -x["votes"], F.abs(x["offset"]), x["offset"])
    best = F.array_min(F.transform(fit, lambda x: F.struct(order(x).alias("order"), x.alias("x"))))["x"]
    # a row where an offset fits; the explosion keeps the judgement from being worked out once per column
    found = histogram.join(left, "q").join(right, "s").withColumn("best", F.explode(F.array_compact(F.array(best))))
    return members, found.select("query_class", "match_class", "best.offset", "best.votes", "best.z.frames", "best.z.errors")


def tune(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", rate: int = 2000, note_s: float = 0.16) -> DataFrame:
    """(key, audio): a WAV recording of each vector, a note for every coordinate; the tables hold no recordings of their
    own. Pitch follows the coordinate in steps, so near copies of a vector sound alike."""
    kind = vectors.schema[key].dataType.simpleString()
    long = int(rate * note_s)
    time = np.arange(long) / rate
    notes = np.stack([np.sin(2 * np.pi * f * time) + 0.4 * np.sin(4 * np.pi * f * time) for f in 220 * 2 ** (np.arange(12) / 12)])
    notes = (notes * np.hanning(long) ** 0.25 * 12_000).astype("<i2")

    def recorded(values: list | None) -> bytes | None:
        if values is None:
            return None
        steps = np.clip(np.floor(np.nan_to_num(np.array(values, float)) * 6) + 6, 0, 11).astype(int)
        out = io.BytesIO()
        with wave.open(out, "wb") as file:
            file.setnchannels(1)
            file.setsampwidth(2)
            file.setframerate(rate)
            file.writeframes(notes[steps].tobytes())
        return out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(recorded, batch.column(1).to_pylist()), pa.binary())], names=["key", "audio"])

    return vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(run, f"key {kind}, audio binary")


def op5(vectors: DataFrame) -> DataFrame:
    """Recordings of all vectors, in two kinds of rows. member: vec_id, its class_id and n_codes. pair: for each class
    with a vec_id divisible by 50, as vec_id, every class_id that aligns with it, with offset, votes, frames, errors."""
    members, pairs = aligned(tune(vectors), "key", "audio", F.col("key") % 50 == 0)
    none = lambda kind: F.lit(None).cast(kind)
    rows = members.select(F.lit("member").alias("kind"), F.col("key").alias("vec_id"), "class_id", "n_codes", none("int").alias("offset"), none("long").alias("votes"), none("int").alias("frames"), none("double").alias("errors"))
    return rows.unionByName(pairs.select(F.lit("pair").alias("kind"), F.col("query_class").alias("vec_id"), F.col("match_class").alias("class_id"), none("int").alias("n_codes"), "offset", "votes", "frames", "errors"))
