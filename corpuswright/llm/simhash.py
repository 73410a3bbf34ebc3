"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is 64 bits from the XXH64 of a text's 3-word shingles. Two fingerprints link at MAX_BITS = 3 differing
bits or fewer. Candidates come from the pigeonring principle: with the 64 bits in a ring of 8 segments and 3 bits to
spend, some segment starts a chain in which the first k segments differ in at most floor(3k / 8) bits for every k, so
0, 0, 1, 1, 1, 2, 2, 3 bits. The first two segments (16 bits) of that chain are therefore equal, and of the next three
(24 bits, one difference at most) one half of 12 bits is equal as well. Those 28 bits with the start and the half are
the key: 16 keys a fingerprint, and no link is lost. Inside a key's bucket the chain of budgets is checked before the
full Hamming distance.

Equal fingerprints are one row before any of this. A bucket's fingerprints are compared in tiles of at most about TILE
rows a side; a larger bucket is dealt over several slices and every pair of slices gets a tile of its own, so no task
holds an unbounded group. A tile emits a spanning forest of its links, never its pairs. Components come from
alternating large-star and small-star steps over those edges.

Texts that are similar by 0.8 of their 5-word shingles differ in 10 bits of 64 or more, which no key of equal bits
reaches. For these (:func:`similar`, which the corpus pipeline uses) a fingerprint has WIDE = 256 bits of the distinct
shingles and links at WIDE_BITS bits; candidates share a band, BAND least hashes of BANDS * BAND, and the ring of
segments is checked over 8 segments of 32 bits before the full distance. The rest is the same.

Defined results: a null, empty or blank text has no words and fingerprint zero, linked like any other; a null key
takes part and is larger than any other; repeated rows are exact copies; a text of any length is hashed in steps of
STEP shingles; only the key and the text are read, so other columns may have any name, and :func:`keep_one` returns all
of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_size, delete, spare, splitmix, through_python, written

MAX_BITS = 3
SEGMENTS = 8
TILE = 2048
SEED = 42
STEP = 1 << 14  # shingles hashed at once
WIDE, WIDE_BITS, WIDE_SHINGLE = 256, 46, 5
BANDS, BAND = 16, 6


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six blanks only


def _shingles(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``width`` words, or of all where there are fewer, STEP at a time."""
    n, digest, joined = len(words), xxhash.xxh64_intdigest, b" ".join(words)
    if n < width:
        yield np.array([digest(joined, SEED)] if n else [], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    for at in range(0, n - width + 1, STEP):
        upto = min(n - width + 1, at + STEP)
        spans = zip(starts[at:upto].tolist(), ends[at + width - 1 : upto + width - 1].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def _bits(hashes: np.ndarray, words: int) -> np.ndarray:
    """How many of the hashes, rows of ``words`` 64-bit integers, have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text, as an unsigned 64-bit integer."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in _shingles(_words(text), 3):
        counts += _bits(hashes, 1)
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


_factors = splitmix(np.arange(BANDS * BAND, dtype=np.uint64)) | np.uint64(1)


def sketch(text: str | None) -> tuple[bytes, np.ndarray]:
    """The wide fingerprint of a text's distinct shingles, and the keys of its bands."""
    found = [np.unique(x) for x in _shingles(_words(text), WIDE_SHINGLE)]
    shingles = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
    counts, least = np.zeros(WIDE, np.int64), np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), STEP):
        part = shingles[at : at + STEP]
        spread = splitmix(part[:, None] + np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * _factors[0])
        counts += _bits(spread, WIDE // 64)
        for k, factor in enumerate(_factors):
            least[k] = min(least[k], (spread[:, 0] * factor).min())
    bands = [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, BAND))]
    return np.packbits(2 * counts > len(shingles), bitorder="little").tobytes(), np.array(bands, np.int64)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint's bits as a signed long."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    return through_python(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run, f"key {kind}, fp long")


def sketches(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, bands) of :func:`sketch`: fp as binary, the bands' keys as an array."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, 1, 1 << 22):
                found = [sketch(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["key", "fp", "bands"])

    return through_python(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run, f"key {kind}, fp binary, bands array<long>")


def bucket_keys(fps: DataFrame) -> DataFrame:
    """(bucket, fp): the 16 chain-start keys of each fingerprint."""
    keys = []
    for start in range(SEGMENTS):
        turned = F.shiftrightunsigned("fp", 8 * start).bitwiseOR(F.shiftleft("fp", 64 - 8 * start)) if start else F.col("fp")
        low = turned.bitwiseAND(F.lit(0xFFFF))
        for half in range(2):
            part = F.shiftrightunsigned(turned, 16 + 12 * half).bitwiseAND(F.lit(0xFFF))
            keys.append(low.bitwiseOR(F.shiftleft(part, 16)).bitwiseOR(F.lit((2 * start + half) << 28)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("bucket"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a-b (places), those of a spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (p := find(x)) != (q := find(y)):
            root[max(p, q)] = min(p, q)
            keep.append(i)
    return a[keep], b[keep]


def _linked(x: np.ndarray, y: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether x and y (unsigned) keep the chain of budgets from segment ``start`` and then the full distance."""
    d = x ^ y
    shift = np.uint64(8) * np.asarray(start, np.uint64)
    turned = np.where(shift == 0, d, (d >> shift) | (d << (np.uint64(64) - shift) % np.uint64(64)))
    fine = (turned & np.uint64(0xFFFF)) == 0
    for k, budget in ((5, 1), (7, 2)):  # where the budget is about to rise: the tightest prefixes of the chain
        fine &= np.bitwise_count(turned & np.uint64((1 << 8 * k) - 1)) <= budget
    return fine & (np.bitwise_count(d) <= MAX_BITS)


def _linked_wide(x: np.ndarray, y: np.ndarray, _start: np.ndarray | int) -> np.ndarray:
    """The same for wide fingerprints, four integers each along the last axis, whose chain may start at any segment."""
    d = x ^ y
    found = np.bitwise_count(d.view(np.uint32)).astype(np.int16)  # of 8 segments
    ring = np.cumsum(np.concatenate((found, found[..., :-1]), axis=-1), axis=-1)
    before = np.concatenate((np.zeros_like(ring[..., :1]), ring[..., : SEGMENTS - 1]), axis=-1)
    chain = np.ones(found.shape, bool)
    for k in range(1, SEGMENTS):
        chain &= 8 * (ring[..., k - 1 : k - 1 + SEGMENTS] - before) <= WIDE_BITS * k
    return chain.any(axis=-1) & (ring[..., SEGMENTS - 1] <= WIDE_BITS)


def _narrow_tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tile_links(batches, False)


def _wide_tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tile_links(batches, True)


def _tile_links(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, tile, side, fp) in order of bucket and tile; out: links (a, b) of a spanning forest of each tile."""
    kept: list[pa.RecordBatch] = []
    linked = _linked_wide if wide else _linked

    def links(frame: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, tile, side = (frame.column(c).to_numpy() for c in ("bucket", "tile", "side"))
        names = frame.column("fp").to_numpy()
        fp = np.frombuffer(b"".join(names), np.uint64).reshape(-1, WIDE // 64) if wide else names.view(np.uint64)
        edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])) + 1
        begins, stops = np.concatenate(([0], edge)), np.concatenate((edge, [len(fp)]))
        found = []
        small = stops - begins <= 32
        # all small tiles at once: each row against the d-th after it, while both are of one tile
        which = np.repeat(np.arange(len(begins)), stops - begins)
        for d in range(1, int(min(32, (stops - begins)[small].max(initial=0)))):
            i = np.flatnonzero((which[:-d] == which[d:]) & small[which[:-d]])
            crossing = (side[i] == 2) | (side[i] != side[i + d])
            i = i[crossing]
            i = i[linked(fp[i], fp[i + d], bucket[i] >> 29)]
            found.append((i, i + d))
        for lo, hi in zip(begins[~small].tolist(), stops[~small].tolist(), strict=True):
            own, start = fp[lo:hi], int(bucket[lo]) >> 29
            whole = side[lo] == 2
            left = np.arange(hi - lo) if whole else np.flatnonzero(side[lo:hi] == 0)
            right = np.arange(hi - lo) if whole else np.flatnonzero(side[lo:hi] == 1)
            for at in range(0, len(left), step := 32 if wide else 256):
                part = left[at : at + step]
                i, j = np.nonzero(linked(own[part][:, None], own[right][None, :], start))
                i, j = part[i], right[j]
                if whole:
                    i, j = i[i < j], j[i < j]
                i, j = _forest(i, j)
                found.append((lo + i, lo + j))
        if found:
            a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            a, b = _forest(a, b)
            swap = names[a] > names[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            kind = pa.binary() if wide else pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(names[a], kind), pa.array(names[b], kind)], names=["a", "b"])

    def whole_tiles(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        nonlocal kept
        for batch in stream:
            if not batch.num_rows:
                continue
            kept.append(batch)
            last = lambda b, i: (b.column("bucket")[i].as_py(), b.column("tile")[i].as_py())
            if last(kept[0], 0) == last(batch, batch.num_rows - 1):
                continue  # one tile so far, of bounded size
            frame = pa.Table.from_batches(kept)
            bucket, tile = frame.column("bucket").to_numpy(), frame.column("tile").to_numpy()
            cut = int(np.flatnonzero((bucket != bucket[-1]) | (tile != tile[-1]))[-1]) + 1
            yield frame.slice(0, cut)
            kept = frame.slice(cut).to_batches()
        if kept:
            yield pa.Table.from_batches(kept)

    for frame in whole_tiles(batches):
        yield from links(frame)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that links connect. ``fps``: distinct column fp."""
    return _links(bucket_keys(fps))


def _links(keys: DataFrame) -> DataFrame:
    """Links of the fingerprints that meet in a bucket: ``keys`` has (bucket, fp), fp a long or a wide one."""
    wide = dict(keys.dtypes)["fp"] == "binary"
    keys = written(keys, "buckets")
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slices = F.ceil(F.col("n") / F.lit(float(TILE))).cast("int")
    met = keys.join(sizes.withColumn("slices", slices), "bucket")
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    dealt = met.withColumn("own", own).withColumn("other", other)
    tile = F.least("own", "other").cast("long") * F.lit(1 << 31) + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = dealt.select("bucket", tile.alias("tile"), side.alias("side"), "fp")
    # the tile of a pair of slices needs both slices whole on their own sides; the tile (s, s) compares within a slice
    sorted_rows = rows.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "fp")
    found = through_python(sorted_rows, _wide_tile_links, "a binary, b binary") if wide else through_python(sorted_rows, _narrow_tile_links, "a long, b long")
    out = written(found.distinct(), "links")
    delete(keys.sparkSession, keys)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the edges (a, b), the smallest node that can be reached.

    Alternates large-star and small-star. A node with many neighbours is pre-aggregated: the minimum comes from a
    partial aggregate and is joined back, so no task gathers a neighbourhood."""
    current = written(edges.select("a", "b").where("a <> b").distinct(), "cc")
    while True:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large-star: every larger neighbour is tied to the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "cc")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small-star: neighbours that are smaller, and the node, are tied to the least of them
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = written(small.where("a <> b").distinct(), "cc")
        # a forest of stars: each node has one parent, and no parent has one
        twice = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        deep = after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
        finished = not twice.count() and not deep.count()
        delete(edges.sparkSession, current, large)
        current = after
        if finished:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): component is the smallest key of the rows that links connect with this one."""
    prints = written(fingerprints(df, key, text), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    return _named(prints, distinct, links(distinct.select("fp")))


def similar(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`near_duplicates`, by wide fingerprints of 5-word shingles and a similarity of about 0.8 or more."""
    prints = written(sketches(df, key, text), "prints")
    distinct, keys = merged_bands(prints)
    return _named(prints.drop("bands"), distinct, _links(keys))


def merged_bands(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, least key) and (fp, bucket) of the distinct fingerprints of (key, fp, bands): different texts of one fingerprint
    can have different bands, and it is looked for in the buckets of all."""
    own = written(prints.groupBy("fp", "bands").agg(F.min("key").alias("least")), "distinct")
    several = own.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    bucket = F.explode("bands").alias("bucket")
    keys = own.join(several, "fp", "left_anti").select("fp", bucket).unionByName(own.join(several, "fp", "left_semi").select("fp", bucket).distinct())
    return own.groupBy("fp").agg(F.min("least").alias("least")), keys


def _named(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    tied = components(edges)
    named = distinct.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    groups = named.join(least, "root").select("fp", "component")
    # a fingerprint may belong to very many rows: Spark splits such partitions of this join, which has one row per fp on its side
    return prints.join(groups, "fp").select("key", "fp", "component")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of :func:`similar` texts: that with the smallest key; of rows that share it, the first by content.
    Rows with a null key come last and stand for their group only if it has no other. Rows are told apart by key and
    text, so rows of different groups that have no key, or share one, each stay."""
    words, (mark, stay, n) = F.col(text).cast("string"), spare(df, "mark", "stay", "n")
    own = df.withColumn(mark, F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(words).alias("h"), F.xxhash64(F.lit(1), words).alias("g")))
    marked = similar(own, mark, text)
    stays = marked.where(F.col("key") == F.col("component")).select(F.col("key").alias(stay)).distinct()
    # the marks that stay grow with the rows: they are never broadcast, whatever their size happens to be
    same = F.col(mark) == F.col(stay)
    rows = own.join(stays.hint("merge"), same, "left_semi")
    again = rows.groupBy(mark).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(F.col(mark).alias(stay))
    once = rows.join(again, same, "left_anti")
    more = rows.join(again, same, "left_semi")
    # rows of one mark have one text; each task passes on one of them at most
    order = Window.partitionBy(mark).orderBy(F.xxhash64(*[F.to_json(F.col(c)) if "map" in t else F.col(c) for c, t in df.dtypes]))
    return once.unionByName(more.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n)).drop(mark)


def op8(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    found = near_duplicates(documents)
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
