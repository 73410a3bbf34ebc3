"""Exact quantiles of groups too large for one task.

Spark's own ``percentile`` keeps all distinct values of a group in the task that ends its aggregation. Here a sketch of
bounded size brackets the quantile first; a second pass counts what lies below the bracket and keeps the distinct values
inside it, a share of 2 * REACH of the rows, of which the ones at the ranks wanted are taken. Results are those of
``percentile``: linear between the two nearest rows.

Defined results: nulls are left out; a group without values has no row; ties, infinities and single rows are fine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import kept as kept_table

ACCURACY = 100_000  # the sketch's rank error is one part in so many
GROUPS = 20_000  # groups whose brackets are broadcast
REACH = 1e-4  # share of rows on either side of the quantile that the bracket takes in; well above the error


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """by, n (values) and q0, q1, ... of each group."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    ends = [min(max(q + side * REACH, 0.0), 1.0) for q in qs for side in (-1, 1)]
    # written, so that its rows can be counted before they are broadcast and are the same in every use
    sketch = kept_table(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", F.array(*map(F.lit, ends)), ACCURACY).alias("_b")), "sketch")
    names = {b: f"_by{k}" for k, b in enumerate(by)}
    side = sketch.select(*[F.col(b).alias(a) for b, a in names.items()], "n", "_b")
    on = [F.col(b).eqNullSafe(F.col(a)) for b, a in names.items()]
    few = not by or sketch.count() <= GROUPS
    met = (rows.join(F.broadcast(side) if few else side, on)) if by else rows.crossJoin(F.broadcast(side))  # one row
    kept = []
    for k in range(len(qs)):
        low, high = F.get("_b", F.lit(2 * k)), F.get("_b", F.lit(2 * k + 1))
        part = F.when(F.col("_x") < low, -1).when(F.col("_x") > high, 1).otherwise(0)
        kept.append(F.struct(F.lit(k).alias("k"), part.alias("part"), F.when(part == 0, F.col("_x")).alias("at")))
    each = met.select(*by, "n", "_x", F.explode(F.array(*kept)).alias("z")).groupBy(*by, "n", "z.k", "z.part", "z.at").agg(F.count(F.lit(1)).alias("c"), F.max("_x").alias("most"), F.min("_x").alias("least"))
    # below the bracket the greatest value counts, above it the least: neighbours that a rank may fall on
    x = F.when(F.col("part") < 0, F.col("most")).when(F.col("part") > 0, F.col("least")).otherwise(F.col("at"))
    order = Window.partitionBy(*by, "k").orderBy("part", "x")
    upto = each.withColumn("x", x).withColumn("upto", F.sum("c").over(order))
    rank = (F.col("n") - 1) * F.element_at(F.array(*map(F.lit, map(float, qs))), F.col("k") + 1)
    here = lambda r: F.min(F.when(F.col("upto") > r, F.struct("upto", "x")))["x"]
    ranked = upto.withColumn("_r", rank).groupBy(*by, "n", "k", "_r").agg(here(F.floor(F.col("_r"))).alias("a"), here(F.ceil(F.col("_r"))).alias("b"))
    found = ranked.withColumn("q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("_r") - F.floor(F.col("_r")))))
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{k}") for k in range(len(qs))])


def with_median(df: DataFrame, by: Sequence[str], value: str, name: str, *more: Column) -> DataFrame:
    """by, the aggregates ``more`` and the median of ``value`` under ``name`` of each group, whatever its size."""
    found = quantiles(df, by, value, [0.5]).select(*[F.col(b).alias(f"_on{k}") for k, b in enumerate(by)], F.col("q0").alias(name))
    rest = df.groupBy(*by).agg(*more)
    return rest.join(found, [F.col(b).eqNullSafe(F.col(f"_on{k}")) for k, b in enumerate(by)], "left").drop(*[f"_on{k}" for k in range(len(by))])
