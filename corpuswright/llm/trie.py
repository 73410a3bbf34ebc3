"""Prefix trie of conversations, as mergeable partial tries.

A node is a distinct sequence of first turns. It is known by its depth and a digest of 124 bits, four sums of turn digest
* base ** place modulo 2 ** 31 - 1. Such sums can be taken from any place on and joined, so turns are numbered and digested
by ``operators.ranks.scanned``, whatever the length of a conversation; no task holds one.

Partitions of turns, in the order of their conversations, emit partial tries: a row for each node they meet with its
members counted, and the members that end there as runs of some RUN ids. Partial tries are merged by the hash of the node
in two rounds, first those of some of the partitions, then all, so that a node that every partition has is summed up by
many tasks. The runs of a node have disjoint ranges of ids, so its list of ends is their concatenation by their first ids;
as SHA-256 can't be merged, one task streams through them, holding one at a time.

Roll-up: a node stands on the path of its smallest member. Nodes of one member (private) have one leaf and save nothing.
The others' sums go along their path from the bottom up, again by ``scanned``, once each path's own total is known where it
leaves its parent's; totals over paths of paths are summed by doubling, in as many rounds as the height of that tree has
binary digits, not one a level.

Defined results: null roles and texts are empty; turns go null first; turns of one number go by role and text; repeated
rows are turns of their own; rows without a conversation's id belong to none and are left out; an empty table gives an
empty result; only the columns named are read, so others may have any name. Texts of any length are read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import PRIME, falling, scanned
from .common import written

BASES = (1_103_515_245, 1_664_525_013, 69_069_691, 1_812_433_253)
LANES = [f"d{k}" for k in range(4)]
RUN = 1024  # ids of a run of ends
ROWS = 200_000  # of a partial trie
NODE = ["depth", "ka", "kb"]


def placed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, d0..d3, bytes) of each turn: its place in its conversation from 0 on, the lanes of its digest and the
    UTF-8 bytes of its text."""
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    lane = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") % PRIME
    order = [F.col(c) for c in ("turn", "role", "text")]
    lean = scanned(rows.select("conv", *[lane(k).alias(d) for k, d in enumerate(LANES)], F.octet_length("text").cast("long").alias("bytes"), *order), ["conv"], order, keep=["conv", *LANES, "bytes"])
    return lean


def held_turns(conv: Column) -> Column:
    """How many first turns a rebuilt conversation takes from its base."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def base_of(conv: Column) -> Column:
    return conv - conv % 5


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, place, d0..d3, bytes) of the rebuilt conversations of :func:`placed` turns: the first turns of the base's,
    then those of their own from the same place on; places have gaps where the base is shorter."""
    turns = written(turns, "turns")
    lean = [*LANES, "bytes"]
    own = turns.where(F.col("place") >= held_turns(F.col("conv"))).select("conv", "place", *lean)
    # a base serves the ids up to 4 beside it
    near = F.explode(F.array(*[F.col("conv") + k for k in range(-4, 5)]))
    lent = turns.where((F.col("conv") % 5 == 0) & (F.col("place") < 8)).select(near.alias("to"), "conv", "place", *lean)
    lent = lent.where((base_of(F.col("to")) == F.col("conv")) & (F.col("place") < held_turns(F.col("to")))).select(F.col("to").alias("conv"), "place", *lean)
    there = turns.where("place = 0").select("conv")
    return own.unionByName(lent.join(there, "conv", "left_semi")).unionByName(_roots(there))


def _roots(there: DataFrame) -> DataFrame:
    return there.select("conv", F.lit(-1).cast("long").alias("place"), *[F.lit(0).cast("long").alias(c) for c in (*LANES, "bytes")])


def whole(turns: DataFrame) -> DataFrame:
    """The conversations of :func:`placed` turns as they are."""
    turns = written(turns, "turns")
    return turns.select("conv", "place", *LANES, "bytes").unionByName(_roots(turns.where("place = 0").select("conv")))


def partial_tries(rows: DataFrame) -> DataFrame:
    """(depth, ka, kb, pa, pb, bytes, conv, n, run) of each node that a partition meets: its key, its parent's, the bytes of
    its last text, smallest member and members; and rows with n = 0 for each run of members that end there, ids joined by
    commas, of which conv is the first."""
    pair = lambda a, b: F.shiftleft(F.col(a), 31).bitwiseOR(F.col(b))
    scan = scanned(rows, ["conv"], [F.col("place")], place="depth", last="end", digests={f"k{k}": (d, BASES[k]) for k, d in enumerate(LANES)}, keep=["conv", "bytes"])
    keyed = scan.select("depth", pair("k0", "k1").alias("ka"), pair("k2", "k3").alias("kb"), pair("k0_before", "k1_before").alias("pa"), pair("k2_before", "k3_before").alias("pb"), "bytes", "conv", "end")

    def trie(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes = rows.group_by([*NODE, "pa", "pb", "bytes"], use_threads=False).aggregate([("conv", "min"), ("conv", "count")])
        n = nodes.num_rows
        yield from pa.table([*[nodes[c] for c in (*NODE, "pa", "pb", "bytes")], nodes["conv_min"], nodes["conv_count"].cast(pa.int64()), pa.nulls(n, pa.string())], names=names).to_batches()
        ends = rows.filter(rows["end"]).group_by(NODE, use_threads=False).aggregate([("conv", "list")])
        found = []
        for key, ids in zip(zip(*[ends[c].to_pylist() for c in NODE], strict=True), ends["conv_list"].to_pylist(), strict=True):
            for at in range(0, len(ids), RUN):
                found.append((*key, 0, 0, 0, ids[at], 0, ",".join(map(str, ids[at : at + RUN]))))
        if found:
            yield from pa.table([pa.array(c, k) for c, k in zip(zip(*found, strict=True), [pa.int64()] * 8 + [pa.string()], strict=True)], names=names).to_batches(max_chunksize=4096)

    names = [*NODE, "pa", "pb", "bytes", "conv", "n", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # a file of the sorted table may follow one of greater ids: no run has ids of both
            ids = batch.column(6).to_numpy()
            back = np.flatnonzero(np.diff(ids, prepend=ids[0] if last is None else last) < 0).tolist()
            last = ids[-1]
            for a, b in zip([0, *back], [*back, len(ids)], strict=True):
                if (a in back or sum(x.num_rows for x in held) >= ROWS) and held:
                    yield from trie(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from trie(pa.Table.from_batches(held))

    return keyed.mapInArrow(run, ", ".join(f"{n} {'string' if n == 'run' else 'long'}" for n in names))


def merged(partial: DataFrame, ways: int = 64) -> DataFrame:
    """The nodes of partial tries: rows of one key summed up, in two rounds."""
    most = [F.first(c).alias(c) for c in ("pa", "pb", "bytes")] + [F.min("conv").alias("conv"), F.sum("n").alias("n")]
    some = partial.where("n > 0").groupBy(*NODE, F.pmod(F.xxhash64("conv"), F.lit(ways)).alias("way")).agg(*most)
    return some.groupBy(*NODE).agg(*most)


def end_lists(partial: DataFrame) -> DataFrame:
    """(depth, ka, kb, ends_sha256) of the nodes where a member ends: the digest of all their ids in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            found = []
            for *at, ids in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if at == key:
                    own.update(b"," + ids.encode())
                else:
                    if key:
                        found.append((*key, own.hexdigest()))
                    key, own = at, hashlib.sha256(ids.encode())
            if found:
                yield table(found)
        if key:
            yield table([(*key, own.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*NODE, "ends_sha256"])

    runs = partial.where("n = 0").repartition(*NODE).sortWithinPartitions(*NODE, "conv").select(*NODE, "run")
    return runs.mapInArrow(run, "depth long, ka long, kb long, ends_sha256 string")


def _totals(paths: DataFrame) -> DataFrame:
    """(path, leaves, saved) with the sums over each path and all below it, from (path, above, leaves, saved); above is null
    where it is the topmost path. After k rounds a row has its sums over 2 ** k levels and knows the path so far above."""
    now = written(paths, "paths")
    while now.where(F.col("above").isNotNull()).limit(1).count():
        below = now.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("path")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        up = now.select(F.col("path").alias("above"), F.col("above").alias("higher"))
        more = now.join(below, "path", "left").join(up, "above", "left")
        now = written(more.select("path", F.col("higher").alias("above"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]), "paths")
    return now


def trie(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node, from the rows
    of :func:`whole` or :func:`rebuilt`."""
    partial = written(partial_tries(rows), "partial")
    nodes = written(merged(partial), "nodes")
    top = F.broadcast(nodes.where("depth = 0").select(F.col("conv").alias("top"), F.col("n").alias("top_n")))  # one row, if any
    over = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv").alias("up"), F.col("n").alias("up_n"))
    first = nodes.where("depth < 2").crossJoin(top).withColumns({"up": F.when(F.col("depth") == 1, F.col("top")), "up_n": F.when(F.col("depth") == 1, F.col("top_n"))}).drop("top", "top_n")
    linked = nodes.where("depth > 1").join(over, ["depth", "pa", "pb"]).unionByName(first)
    linked = written(linked.join(end_lists(partial), NODE, "left").select("depth", "conv", "n", "bytes", "up", "up_n", "ends_sha256"), "linked")

    at = ["conv", "depth"]
    children = linked.where("depth > 0").groupBy(F.col("up").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if((F.col("n") == 1) & (F.col("up_n") > 1)).alias("tails"))
    full = written(linked.join(children, at, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_children", "tails")}), "full")
    # nodes with more than one member: their own leaf and bytes, and the leaves of the private tails that hang on them
    shared = full.where("n > 1").withColumns({"leaves": F.col("tails") + (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("bytes")})
    heads = shared.where(F.col("up").isNotNull() & (F.col("up") != F.col("conv"))).select(F.col("conv").alias("path"), F.col("up").alias("above"), (F.col("depth") - 1).alias("hangs"))
    sums = shared.groupBy(F.col("conv").alias("path")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    lanes = heads.join(sums, "path").crossJoin(top)
    totals = _totals(lanes.select("path", F.when(F.col("above") != F.col("top"), F.col("above")).alias("above"), "leaves", "saved"))
    hung = heads.join(totals.select("path", "leaves", "saved"), "path").groupBy(F.col("above").alias("conv"), F.col("hangs").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    own = shared.join(hung, at, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")
    summed = scanned(own, ["conv"], [falling(F.col("depth"))], sums={"deep_leaves": "leaves", "deep_saved": "saved"})
    out = lambda leaves, saved: [
        F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    ]
    private = full.where("n = 1").select(*out(F.lit(1).cast("long"), F.lit(0).cast("long")))
    return private.unionByName(summed.select(*out(F.col("leaves") + F.col("deep_leaves"), F.col("saved") + F.col("deep_saved"))))


def last_turns(nodes: DataFrame, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of :func:`whole` conversations with the role and text of their last turns (null for the root)."""
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    own = scanned(rows, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")]).select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text")
    return nodes.join(own, ["conv_id", "depth"], "left")


def op11(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(placed(conversations)))
