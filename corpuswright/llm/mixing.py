"""Mixing sources to target weights by pivotal dependent rounding [native].

Each source gets a target in words; each of its documents then has an expected number of copies, target / size of the
source. The whole copies are certain. The fractions left over are rounded dependently: two documents at a time trade
word mass, up or down at odds that keep both expectations, until one of them is whole. The other carries the residual
on. Trades go on inside blocks of some FAN documents in one array expression, the residuals of the blocks form the next
level, and so on up a tree of fan-in FAN. The one residual left at the root of a source goes to the nearer side, so
that a source's words miss its target by at most half of its last document.

Defined results: a null text has no words; a null source is a source of its own, ordered last; documents without words
carry no mass and are rounded on their own; rows equal in doc_id, source and content share their copies evenly and any
of them may get the odd one; rows are told apart by two 64-bit hashes; an empty table gives an empty result. Draws depend on doc_id, source, content and seed
only, so reruns agree. Input columns may have any name: :func:`mix` returns them all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_words, spare, uniform, written

FAN = 96  # documents of a block on average; bounds the array of one row
MOST = 3  # times its source's size that a target may reach
WEIGHTS = (1, 2, 3)
AT_ONCE = 10_000  # copies of one row that a task makes


def ranked(spark_sources: DataFrame, by: str) -> DataFrame:
    """Adds ``rank`` from 0 by ``by`` (code points, null last) without bringing all rows to one task."""
    ordered = spark_sources.repartitionByRange(F.col(by).asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    kept = written(ordered.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(F.col(by).asc_nulls_last()))), "rank")
    parts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition at most
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return kept.join(starts, "_part").withColumn("rank", F.col("_start") + F.col("_at") - 1).drop("_part", "_at", "_start")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target, ratio from rows (source, size). The level at which uncapped sources share
    what capped ones leave is found by summing again until no further source is above its cap."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written(ranked(sources, "source").select("source", "source_size", "n_docs", weight.alias("weight")), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    whole = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > cap
        row = table.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (whole - row[1]) / row[2]
    target = F.least(cap, F.col("weight") * F.lit(level))
    return table.withColumn("target", target).withColumn(
        "ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def _item(key: Column, size: Column, x: Column) -> Column:
    return F.struct(key.alias("key"), size.alias("size"), x.alias("x"))


def _trade(carry: Column, other: Column, seed: int) -> Column:
    """One pivotal step as (settled item, carried item). Word mass moves between the two; one becomes whole."""
    a, b = (z["x"] * z["size"] for z in (carry, other))
    free_a, free_b = ((1 - z["x"]) * z["size"] for z in (carry, other))
    up, down = F.least(free_a, b), F.least(a, free_b)  # mass that can go to the carried item, or away from it
    rise = uniform(carry["key"], other["key"], F.lit(seed)) * (up + down) < down
    moved = F.when(rise, up).otherwise(-down)
    snap = lambda v: F.when(v < 1e-9, 0.0).when(v > 1 - 1e-9, 1.0).otherwise(v)
    new_carry = _item(carry["key"], carry["size"], snap((a + moved) / carry["size"]))
    new_other = _item(other["key"], other["size"], snap((b - moved) / other["size"]))
    done = (new_carry["x"] == 0.0) | (new_carry["x"] == 1.0)
    return F.struct(F.when(done, new_carry).otherwise(new_other).alias("settled"), F.when(done, new_other).otherwise(new_carry).alias("carry"))


def _settled(items: DataFrame, seed: int) -> DataFrame:
    """A row per (source, block) with the settled items of the block and the item that is carried on."""
    kind = items.schema["key"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<struct<key: {kind}, size: double, x: double>>").alias("settled"), F.get("items", F.lit(0)).alias("carry"))

    def step(state: Column, item: Column) -> Column:
        # one evaluation of the trade, through a one-element array
        traded = F.transform(F.array(_trade(state["carry"], item, seed)), lambda t: F.struct(F.concat(state["settled"], F.array(t["settled"])).alias("settled"), t["carry"].alias("carry")))
        return F.get(traded, F.lit(0))

    blocks = items.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("key", "size", "x"))).alias("items"))
    rest = F.slice("items", F.lit(2), F.size("items"))
    return blocks.select("source", "block", F.aggregate(rest, start, step).alias("state"))


def _rounded(items: DataFrame, largest: int, seed: int) -> DataFrame:
    """(key, one): every fractional item (source, n_items, key, size, x) as 0 or 1, through the reduction tree."""
    settled, n = [], F.ceil(F.col("n_items") / F.lit(float(FAN))).cast("long")
    level, current = 0, items
    while True:
        blocks = current.withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed), F.lit(level)), F.greatest(n, F.lit(1))))
        done = written(_settled(blocks.select("source", "block", "key", "size", "x"), seed + level), f"mix{level}")
        settled.append(done.select(F.explode("state.settled").alias("z")).select("z.key", F.col("z.x").alias("one")))
        current = done.select("source", "state.carry.key", "state.carry.size", "state.carry.x")
        whole = (F.col("x") == 0.0) | (F.col("x") == 1.0)
        if largest <= FAN:  # a single block is left of each source; its residual has nothing to trade with
            draw = F.when(F.col("x") >= 0.5, 1.0).otherwise(0.0)
            settled.append(current.select("key", F.when(whole, F.col("x")).otherwise(draw).alias("one")))
            break
        settled.append(current.where(whole).select("key", F.col("x").alias("one")))
        current = current.where(~whole)
        largest, level = math.ceil(largest / FAN), level + 1
        per_source = Window.partitionBy("source")
        current = current.withColumn("n_items", F.count(F.lit(1)).over(per_source)) if largest <= FAN else current.join(
            current.groupBy("source").agg(F.count(F.lit(1)).alias("n_items")).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
        ).drop("_s")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionAll(more)
    return out


def plan(rows: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """How often each distinct row (key, source, size) is taken: its columns, n_rows (equal rows), source_size, target,
    and copies (of all its rows together). ``key`` stands for what makes a row distinct, as :func:`identity` gives it."""
    sizes = written(rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "sizes")
    shares = written(targets(sizes.select("source", (F.col("size") * F.col("n_rows")).alias("size")), weights, most).drop("n_docs", "weight"), "targets")
    # sources are few beside rows, yet unbounded: Spark chooses the join by their measured size
    shares = shares.select(F.col("source").alias("_s"), "source_size", "target", "ratio")
    put = sizes.join(shares, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    each = F.col("ratio") * F.col("n_rows")
    put = put.withColumn("whole", F.floor(each + 1e-9)).withColumn("x", F.greatest(each - F.col("whole"), F.lit(0.0)))
    loose = (F.col("x") > 1e-9) & (F.col("size") > 0)
    alone = F.when((F.col("size") <= 0) & (uniform(F.col("key"), F.lit(seed)) < F.col("x")), 1).otherwise(0)
    placed = written(put.withColumn("loose", loose).withColumn("alone", alone), "placed")
    counts = placed.where("loose").groupBy("source").agg(F.count(F.lit(1)).alias("n_items"))
    largest = counts.agg(F.coalesce(F.max("n_items"), F.lit(0))).first()[0]
    if not largest:
        return placed.withColumn("copies", F.col("whole") + F.col("alone")).select("key", "source", "size", "n_rows", "source_size", "target", "copies")
    counts = counts.withColumnRenamed("source", "_s")
    items = placed.where("loose").join(counts, F.col("source").eqNullSafe(F.col("_s"))).select("source", "n_items", "key", F.col("size").cast("double").alias("size"), "x")
    ones = _rounded(items, largest, seed).withColumnRenamed("key", "_k")
    joined = placed.join(ones, F.col("key") == F.col("_k"), "left")
    copies = F.col("whole") + F.when(F.col("loose"), F.coalesce("one", F.lit(0.0)).cast("long")).otherwise(F.col("alone"))
    return joined.withColumn("copies", copies.cast("long")).select("key", "source", "size", "n_rows", "source_size", "target", "copies")


def identity(*columns: Column) -> Column:
    """128 bits that stand for the columns."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def repeated(df: DataFrame, by: str, n: str, at: str) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``at``; AT_ONCE of them at most come from one task at once. ``by`` is its key."""
    every, last = F.lit(AT_ONCE).cast("long"), F.col(n).cast("long") - 1
    begun = df.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), last, every)))
    dealt = begun.repartition(F.xxhash64(by, at))
    return dealt.withColumn(at, F.explode(F.sequence(F.col(at), F.least(F.col(at) + every - 1, last))))


def mix(df: DataFrame, text: str = "text", source: str = "source", seed: int = 0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``df``, each repeated as often as the mix takes it (rows taken no times are gone)."""
    key, own, size, chosen_key, n_rows, copies, n, at = spare(df, "key", "own", "size", "chosen", "n_rows", "copies", "n", "at")
    whole = [F.to_json(F.col(c)) if "map" in t else F.col(c) for c, t in df.dtypes]
    keyed = df.withColumns({key: identity(*whole), own: F.col(source).cast("string"), size: count_words(F.col(text))})
    chosen = plan(keyed.select(F.col(key).alias("key"), F.col(own).alias("source"), F.col(size).alias("size")), seed, weights)
    chosen = written(chosen.where("copies > 0").select(F.col("key").alias(chosen_key), F.col("n_rows").alias(n_rows), F.col("copies").alias(copies)), "chosen")
    met = keyed.join(chosen.hint("merge"), F.col(key) == F.col(chosen_key))  # grows with the rows: never broadcast
    # every one of equal rows gets the whole share of its copies, and one of them the copies that are left over
    each = met.withColumn(n, F.floor(F.col(copies) / F.col(n_rows)).cast("int")).where(F.col(n) > 0)
    each = each.withColumn(at, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*df.columns)
    over = met.where(F.col(copies) % F.col(n_rows) > 0).dropDuplicates([key]).withColumn(n, F.col(copies) % F.col(n_rows))
    return each.unionByName(repeated(over, key, n, at).select(*df.columns))


def op1(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source of every document."""
    rows = documents.select("doc_id", "source", count_words(F.col("text")).alias("size"), identity(F.col("doc_id"), F.col("source"), F.col("text")).alias("key"))
    rows = written(rows, "words")
    chosen = plan(rows.select("key", "source", "size"))
    single = chosen.where("n_rows = 1").withColumn("at", F.lit(0).cast("long"))
    many = repeated(chosen.where("n_rows > 1"), "key", "n_rows", "at")
    share = F.floor(F.col("copies") / F.col("n_rows")) + F.when(F.col("at") < F.col("copies") % F.col("n_rows"), 1).otherwise(0)
    shares = single.unionByName(many).withColumn("copies", share.cast("long")).drop("n_rows", "at")
    # doc_id comes back through the key; equal rows are equal in doc_id too
    ids = rows.groupBy("key").agg(F.first("doc_id").alias("doc_id"))
    return shares.join(ids, "key").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")
