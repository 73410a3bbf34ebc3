"""Bootstrap over authors by draws with replacement, each replicate with exactly as many draws as there are authors.

A replicate's counts of authors are multinomial. They are drawn down a tree: authors lie in buckets by hash, of some BUCKET
each; a replicate first splits its draws over the buckets, a binomial a bucket given what is left, and each bucket then
deals its draws to its own authors. Neither step needs a numbering of all authors, a row for each author and replicate or a
task that sees more than a bucket, and both depend on the seed, the replicate and the bucket alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panel import LEAST_AUTHORS

BUCKET = 4096
SIDES = "ab"


def split(rng: np.random.Generator, draws: int, sizes: np.ndarray) -> np.ndarray:
    """How many of the draws fall into parts of these sizes."""
    out, left, whole = np.zeros(len(sizes), np.int64), draws, int(sizes.sum())
    for k, size in enumerate(sizes.tolist()):
        if not left:
            break
        out[k] = left if size == whole else rng.binomial(left, size / whole)
        left, whole = left - int(out[k]), whole - size
    return out


def replicate_sums(sums: DataFrame, n: int, seed: int, bucket: int = BUCKET) -> DataFrame:
    """(side, rep, s, c, draws) from (side, author, s, c): the sums of each replicate's authors."""
    spark = sums.sparkSession
    totals = {r.side: r.n for r in sums.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return spark.createDataFrame([], "side string, rep int, s double, c long, draws long")
    buckets = {side: -(-m // bucket) for side, m in totals.items()}
    number = F.element_at(F.create_map(*[F.lit(x) for pair in buckets.items() for x in pair]), F.col("side"))
    dealt = sums.withColumn("bucket", F.pmod(F.xxhash64("author"), number).cast("int"))
    sizes = {side: np.zeros(b, np.int64) for side, b in buckets.items()}
    for r in dealt.groupBy("side", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for some BUCKET authors
        sizes[r.side][r.bucket] = r.n
    held = spark.sparkContext.broadcast(sizes)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side, rep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.value[side]
                drawn = split(np.random.default_rng([seed, SIDES.index(side), rep]), int(own.sum()), own)
                k = np.flatnonzero(drawn)
                yield pa.RecordBatch.from_arrays([pa.array([side] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(np.full(len(k), rep, np.int32)), pa.array(drawn[k])], names=["side", "bucket", "rep", "draws"])

    def deal(authors: pa.Table, draws: pa.Table) -> pa.Table:
        authors = authors.sort_by("author")
        s, c = (authors[x].to_numpy().astype(float) for x in ("s", "c"))
        rows = []
        for side, at, rep, k in zip(*[draws[x].to_pylist() for x in ("side", "bucket", "rep", "draws")], strict=True):
            if len(s):
                times = np.bincount(np.random.default_rng([seed, SIDES.index(side), rep, at, 1]).integers(0, len(s), k), minlength=len(s))
                rows.append((side, rep, float(times @ s), int(times @ c), int(times.sum())))
        kinds = [pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], names=["side", "rep", "s", "c", "draws"])

    plan = spark.range(n).select(F.explode(F.array(*[F.lit(x) for x in sorted(totals)])).alias("side"), F.col("id").cast("int").alias("rep"))
    draws = plan.mapInArrow(spread, "side string, bucket int, rep int, draws long")
    authors = dealt.select("side", "bucket", F.col("author").cast("string").alias("author"), F.col("s").cast("double").alias("s"), F.col("c").cast("long").alias("c"))
    found = authors.groupBy("side", "bucket").cogroup(draws.groupBy("side", "bucket")).applyInArrow(deal, "side string, rep int, s double, c long, draws long")
    return found.groupBy("side", "rep").agg(*[F.sum(x).alias(x) for x in ("s", "c", "draws")])


def interval(panel: DataFrame, a: Column, b: Column, n: int = 400, seed: int = 42) -> DataFrame:
    """replicates, low and high: the 95 % interval of the difference of means, authors drawn with replacement. None with
    under LEAST_AUTHORS on a side or if under half of the replicates have values on both."""
    rows = panel.where(a | b).withColumn("side", F.when(a, "a").otherwise("b"))
    sums = rows.groupBy("side", "author").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("s"), F.count("value").alias("c"))
    authors = sums.groupBy("side").agg(F.count(F.lit(1)).alias("n")).agg(F.when(F.count(F.lit(1)) == 2, F.min("n")).otherwise(0).alias("authors"))
    of = lambda side, x: F.sum(F.when(F.col("side") == side, F.col(x)))
    mean = lambda side: of(side, "s") / F.nullif(of(side, "c"), F.lit(0))
    each = replicate_sums(sums, n, seed).groupBy("rep").agg((mean("b") - mean("a")).alias("d"))
    found = each.agg(F.sort_array(F.collect_list("d")).alias("d")).crossJoin(authors)  # n values, one row
    valid = (F.col("authors") >= LEAST_AUTHORS) & (F.size("d") >= n // 2)
    pick = lambda q: F.when(valid, F.get("d", (F.lit(q) * (F.size("d") - 1)).cast("int")))
    return found.select(F.size("d").cast("long").alias("replicates"), pick(0.025).alias("low"), pick(0.975).alias("high"))
