"""Draws with replacement against the multinomial law."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpuswright.operators import resample


def test_each_replicate_has_its_draws_and_their_law(spark):
    m, n = 300, 600
    rows = [("a", f"x{k}", float(k == 0), 1) for k in range(m)] + [("b", f"y{k}", float(k < 3), 1) for k in range(40)]
    got = resample.replicate_sums(spark.createDataFrame(rows, "side string, author string, s double, c long"), n, 7, bucket=50).toPandas()
    assert set(got[got.side == "a"].draws) == {m}
    assert set(got[got.side == "b"].draws) == {40}
    assert len(got) == 2 * n
    for side, p, size in (("a", 1 / m, m), ("b", 3 / 40, 40)):  # the first authors' counts are binomial
        counts = got[got.side == side].s.to_numpy()
        mean, var = size * p, size * p * (1 - p)
        assert abs(counts.mean() - mean) < 5 * np.sqrt(var / n)
        assert abs(counts.var() - var) < 5 * var * np.sqrt(2 / n) * 1.6
    again = resample.replicate_sums(spark.createDataFrame(rows[::-1], "side string, author string, s double, c long").repartition(3), n, 7, bucket=50).toPandas()
    key = ["side", "rep"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_split_gives_all_draws_away():
    rng = np.random.default_rng(1)
    sizes = np.array([5, 0, 1, 100, 0])
    for _ in range(200):
        out = resample.split(rng, 50, sizes)
        assert out.sum() == 50
        assert out[1] == out[4] == 0


def test_interval_covers_and_has_gates(spark):
    rng = np.random.default_rng(0)
    rows = [(p, f"{p}{k % 60}", float(rng.normal(10 if p == "a" else 12, 1))) for p in "ab" for k in range(240)]
    df = spark.createDataFrame(rows, "period string, author string, value double")
    got = resample.interval(df, F.col("period") == "a", F.col("period") == "b", 200).first()
    assert got.replicates == 200
    assert got.low < 2 < got.high
    assert got.high - got.low < 1
    few = df.where("period = 'b' or author in ('a1', 'a2', 'a3', 'a4')")
    assert resample.interval(few, F.col("period") == "a", F.col("period") == "b", 50).first().low is None
    assert resample.interval(df.where("period = 'a'"), F.col("period") == "a", F.col("period") == "b", 50).first().low is None
