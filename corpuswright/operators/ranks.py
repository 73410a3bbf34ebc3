"""Places and running sums inside groups of any size.

Spark's window functions hold a group in one task. Here rows are dealt by range over group and order, so a group lies in
as many neighbouring partitions as it needs. Each task numbers the rows of each of its groups and sums them up from there;
only its first group can have begun in an earlier partition. What that group has before is known from the partitions'
first and last rows, two a partition, which the driver adds up; it is added to the rows of first groups by a broadcast
table of a row a partition. So a task holds a batch, whatever the size of a group.

The dealt rows are written to the shared folder before the second look, as range limits come from a sample and would not
be the same again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import kept

Key = Column | tuple[Column, str]
#: A prime; running digests are sums of value * base ** place modulo it.
PRIME = (1 << 31) - 1
SMALL = 100_000  # groups whose sizes are broadcast


class _Runs:
    """Numbers the rows of one partition's batches."""

    def __init__(self, sums: int, bases: Sequence[int]) -> None:
        self.group, self.place, self.first = None, 0, True
        self.sums = [0] * sums
        self.bases = bases
        self.digests = [0] * len(bases)
        self.powers = [np.ones(1, np.int64) for _ in bases]

    def _power(self, lane: int, most: int) -> np.ndarray:
        own, base = self.powers[lane], self.bases[lane]
        while len(own) <= most:
            own = np.concatenate((own, own * pow(base, len(own), PRIME) % PRIME))
        self.powers[lane] = own
        return own

    def __call__(self, group: pa.Array, values: list[np.ndarray], terms: list[np.ndarray]) -> tuple:
        n = len(group)
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(group.slice(1), group.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        key = group[0].as_py()
        new[0] = self.group is None or key != self.group
        begins = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        over = begins < 0  # rows of a group that an earlier batch began
        place = np.where(over, np.arange(n) + self.place, np.arange(n) - begins)
        first = np.full(n, self.first) & ((np.cumsum(new) == 0) if self.group is not None else (np.cumsum(new) == 1))
        before, terms_ = [], []
        for k, v in enumerate(values):
            upto = np.cumsum(v) - v
            before.append(np.where(over, upto + self.sums[k], upto - upto[begins]))
        for k, v in enumerate(terms):
            v = v * self._power(k, int(place.max()))[place] % PRIME
            terms_.append(v)
            upto = np.cumsum(v) - v
            before.append(np.where(over, upto + self.digests[k], upto - upto[begins]) % PRIME)
            self.digests[k] = int((before[-1][-1] + v[-1]) % PRIME)
        for k, v in enumerate(values):
            self.sums[k] = int(before[k][-1] + v[-1])
        self.first = bool(first[-1])
        self.group, self.place = group[n - 1].as_py(), int(place[-1]) + 1
        return place, first, new, [*before, *terms_]


def scanned(df: DataFrame, by: Sequence[str], order: Sequence[Key], place: str = "place", last: str | None = None, sums: Mapping[str, str] | None = None, digests: Mapping[str, tuple[str, int]] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """The rows with their place in their group, from 0 on; with ``last``, whether a row ends its group; with ``sums``
    (new name: whole-number column), the sum over the rows before it; with ``digests`` (new name: (column of numbers under
    PRIME, base)), the sum of value * base ** place over the rows up to it, modulo PRIME, and under the name with ``_before``
that of the rows before it.

    ``keep``: the columns of the rows that the result has, all by default.
    Rows of one place in the order go as they come; nulls are a group and sort first, and count as 0 in sums. Without
    ``by`` all rows are one group. An empty table gives an empty result."""
    spark, sums, digests = df.sparkSession, dict(sums or {}), dict(digests or {})
    group = F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("")
    lanes = [*sums.values(), *(c for c, _ in digests.values())]
    made = [*sums, *digests]
    whole = F.struct(*[F.col(c) for c in (df.columns if keep is None else keep)])
    # the last key tells equal rows apart, so that they can be dealt out too
    keys = [k if isinstance(k, tuple) else (k, "asc") for k in (*[F.col(c) for c in by], *order, F.monotonically_increasing_id())]
    inner = df.select(whole.alias("row"), group.alias("g"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"v{k}") for k, c in enumerate(lanes)], *[c.alias(f"k{k}") for k, (c, _) in enumerate(keys)])
    ways = [F.col(f"k{k}").desc() if way == "desc" else F.col(f"k{k}").asc() for k, (_, way) in enumerate(keys)]
    dealt = inner.repartitionByRange(*ways).sortWithinPartitions(*ways).select("row", "g", *[f"v{k}" for k in range(len(lanes))])
    bases = [b for _, b in digests.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, part, held = _Runs(len(sums), bases), TaskContext.get().partitionId(), None

        def out(ends: bool) -> pa.RecordBatch:
            arrays, places, first, new, before = held
            n = len(places)
            stops = np.append(new[1:], ends)
            edge = np.zeros((2, n), bool)
            edge[0, 0], edge[1, -1] = head, tail
            return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(n, part, np.int32)), *map(pa.array, (places, first, stops, edge[0], edge[1])), *map(pa.array, before)], names=names)

        head, tail = True, False
        for batch in batches:
            if not batch.num_rows:
                continue
            lanes_ = [batch.column(2 + k).to_numpy() for k in range(len(lanes))]
            numbered = runs(batch.column(1), lanes_[: len(sums)], lanes_[len(sums) :])
            if held:
                yield out(bool(numbered[2][0]))
                head = False
            held = ([batch.column(k) for k in range(2 + len(lanes))], *numbered)
        if held:
            tail = True
            yield out(True)

    names = ["row", "g", *[f"v{k}" for k in range(len(lanes))], "part", "place", "first", "stops", "head", "tail", *[f"b{k}" for k in range(len(made))], *[f"t{k}" for k in range(len(bases))]]
    kinds = {"part": "int", "place": "long", "first": "boolean", "stops": "boolean", "head": "boolean", "tail": "boolean", "g": "string", **{f"v{k}": "long" for k in range(len(lanes))}, **{f"b{k}": "long" for k in range(len(made))}, **{f"t{k}": "long" for k in range(len(bases))}}
    rows = kept(dealt.mapInArrow(run, ", ".join(f"`{n}` {kinds.get(n) or dealt.schema['row'].dataType.simpleString()}" for n in names)), "scan")
    carried = _carried(rows, len(sums), bases)
    shape = "part int, c long, goes boolean" + "".join(f", c{k} long" for k in range(len(made)))
    met = rows.join(F.broadcast(spark.createDataFrame(carried, shape)), "part", "left")  # a row a partition
    add = lambda c: F.when(F.col("first"), F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0))
    results = [(F.col("place") + add("c")).alias(place)]
    if last:
        results.append((F.col("stops") & ~(F.col("tail") & F.coalesce("goes", F.lit(False)))).alias(last))
    for k, name in enumerate(made):
        if k < len(sums):
            results.append((F.col(f"b{k}") + add(f"c{k}")).alias(name))
        else:  # carried digest + base ** carried rows * own
            factor = F.when(F.col("first") & (F.col("c") > 0), F.col(f"p{k}")).otherwise(F.lit(1))
            before = F.pmod(add(f"c{k}") + factor * F.col(f"b{k}"), F.lit(PRIME))
            results += [before.alias(f"{name}_before"), F.pmod(before + factor * F.col(f"t{k - len(sums)}"), F.lit(PRIME)).alias(name)]
    if bases:
        powers = [(part, *[pow(b, n, PRIME) for b in bases]) for part, n, *_ in carried]
        met = met.join(F.broadcast(spark.createDataFrame(powers, "part int" + "".join(f", p{len(sums) + k} long" for k in range(len(bases))))), "part", "left")
    return met.select("row.*", *results)


def falling(column: Column) -> Key:
    """A sort key from high to low, nulls last; plain columns rise, nulls first."""
    return column, "desc"


def _carried(rows: DataFrame, sums: int, bases: Sequence[int]) -> list[tuple]:
    """(part, rows, goes on, sums...) of each partition: what its first group has in the partitions before, and whether its
    last group goes on in the next."""
    made = sums + len(bases)
    edges = rows.where("head or tail").select("part", "g", "place", "first", "head", "tail", *[f"v{k}" for k in range(made)], *[f"b{k}" for k in range(made)]).collect()
    heads = {r["part"]: r["g"] for r in edges if r["head"]}
    tails = {r["part"]: r for r in edges if r["tail"]}
    out: list[tuple] = []
    group, n, total = None, 0, [0] * made
    for part in sorted(heads):
        same = group is not None and heads[part] == group
        c, cs = (n, total) if same else (0, [0] * made)
        if same:
            out[-1] = (*out[-1][:2], True, *out[-1][3:])
        out.append((part, c, False, *cs))
        end = tails[part]
        begun, was = (c, cs) if end["first"] else (0, [0] * made)
        own = [end[f"b{k}"] + end[f"v{k}"] for k in range(sums)]
        lanes = [(end[f"b{sums + k}"] + end[f"v{sums + k}"] * pow(b, end["place"], PRIME)) % PRIME for k, b in enumerate(bases)]
        total = [a + b for a, b in zip(was, own, strict=False)] + [(was[sums + k] + pow(b, begun, PRIME) * lanes[k]) % PRIME for k, b in enumerate(bases)]
        group, n = end["g"], begun + end["place"] + 1
    return out


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Key], tiles: int | None = None) -> DataFrame:
    """The rows with row_number (from 1) and group_rows of their group, and with ``tiles`` their ntile, as Spark's windows
    give them; the order must tell rows apart for the same result in each run."""
    rows = scanned(df, by, order, place="_place", last="_last")
    sizes = rows.where("_last").select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], (F.col("_place") + 1).alias("group_rows"))
    few = not by or sizes.limit(SMALL + 1).count() <= SMALL
    met = rows.join(F.broadcast(sizes) if few else sizes, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)], "inner") if by else rows.crossJoin(F.broadcast(sizes))  # one row
    out = [*[c for c in df.columns], (F.col("_place") + 1).alias("row_number"), "group_rows"]
    if tiles:
        each, more = F.floor(F.col("group_rows") / tiles), F.col("group_rows") % tiles
        wide = more * (each + 1)  # rows in the tiles that have one more
        tile = F.when(F.col("_place") < wide, F.floor(F.col("_place") / (each + 1))).otherwise(more + F.floor((F.col("_place") - wide) / F.greatest(each, F.lit(1)))) + 1
        out.append(tile.cast("int").alias("ntile"))
    return met.select(*out)


def percent_ranked(df: DataFrame, by: Sequence[str], value: str, high_first: bool = False) -> DataFrame:
    """The rows with percent_rank of ``value`` in their group: the share of the other rows that come before, ties alike."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    runs = scanned(counts, by, [falling(F.col(value)) if high_first else F.col(value)], sums={"_before": "_n"})
    names = {c: f"_c{k}" for k, c in enumerate([*by, value])}
    whole = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    on = lambda left, keys: [F.col(c).eqNullSafe(F.col(left[c])) for c in keys]
    sizes = whole.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], "_all")
    sized = runs.join(sizes, on({c: f"_g{k}" for k, c in enumerate(by)}, by)) if by else runs.crossJoin(F.broadcast(sizes))  # one row
    side = sized.select(*[F.col(c).alias(a) for c, a in names.items()], F.when(F.col("_all") > 1, F.col("_before") / (F.col("_all") - 1)).otherwise(0.0).alias("percent_rank"))
    return df.join(side, on(names, [*by, value])).select(*df.columns, "percent_rank")
