"""Places, running sums and tiles against plain Python."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuswright.operators import ranks
from corpuswright.operators.panel import top_share

ROWS = [(None, k % 3, k) for k in range(7)] + [("a", None, 5), ("a", 2, 9), ("a", 1, None)] + [("hot", k // 2, 1) for k in range(400)] + [("same", 1, 2)] * 50 + [("z", 0, -4)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "g string, k int, v long").repartition(5)


def test_places_sums_and_digests(frame):
    got = ranks.scanned(frame, ["g"], [F.col("k"), F.col("v")], last="end", sums={"before": "v"}, digests={"d": ("k", 1_234_567), "e": ("k", 7)}).collect()
    assert len(got) == len(ROWS)
    key = lambda r: (r.g is not None, r.g or "")
    for g, own in itertools.groupby(sorted(got, key=lambda r: (key(r), r.place)), key):
        own = list(own)
        order = lambda x: (x is not None, x if x is not None else 0)
        assert [(r.k, r.v) for r in own] == sorted(((r.k, r.v) for r in own), key=lambda x: (order(x[0]), order(x[1])))
        total, digests = 0, [0, 0]
        for n, r in enumerate(own):
            assert (r.place, r.end, r.before, r.d_before, r.e_before) == (n, n == len(own) - 1, total, *digests)
            total += r.v or 0
            digests = [(d + (r.k or 0) * pow(b, n, ranks.PRIME)) % ranks.PRIME for d, b in zip(digests, (1_234_567, 7), strict=True)]
            assert [r.d, r.e] == digests


def test_a_group_lies_in_many_partitions(frame):
    parts = ranks.scanned(frame.where("g = 'hot' or g = 'same'"), [], [F.col("g")], place="p").withColumn("part", F.spark_partition_id())
    assert parts.select("p").distinct().count() == 450
    assert parts.agg(F.max("p")).head()[0] == 449


def test_tiles_are_those_of_windows(frame):
    order = Window.partitionBy("g").orderBy(F.desc("k"), "v")
    want = frame.where("g <> 'same'").select("g", "k", "v", F.ntile(4).over(order).alias("ntile"), F.row_number().over(order).alias("row_number"), F.count(F.lit(1)).over(Window.partitionBy("g")).alias("group_rows"))
    got = ranks.ranked(frame.where("g <> 'same'"), ["g"], [ranks.falling(F.col("k")), F.col("v")], tiles=4).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_nothing_and_clashing_names(spark, frame):
    assert ranks.scanned(frame.limit(0), ["g"], [F.col("k")], sums={"s": "v"}, digests={"d": ("k", 3)}).count() == 0
    odd = frame.select(F.col("g").alias("row"), F.col("k").alias("part"), F.col("v").alias("head"))
    assert ranks.scanned(odd, ["row"], [F.col("part")], sums={"s": "head"}).count() == len(ROWS)
    assert set(ranks.scanned(odd, ["row"], [F.col("part")]).columns) == {"row", "part", "head", "place"}


def test_top_share_of_many_values(spark):
    values = [k % 97 for k in range(2000)]
    got = {r.share: r.sum_pct for r in top_share(spark.createDataFrame([(v,) for v in values], "v int"), "v", (0.01, 0.5)).collect()}
    order = sorted(values, reverse=True)
    assert got[0.01] == pytest.approx(100 * sum(order[:20]) / sum(order))
    assert got[0.5] == pytest.approx(100 * sum(order[:1000]) / sum(order))
