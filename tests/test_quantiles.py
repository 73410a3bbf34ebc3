"""Quantiles that hold no group, against Spark's own percentile."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpuswright.operators import panel
from corpuswright.operators.quantiles import quantiles


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 101, 1000, 40_000])
def test_equal_to_percentile(spark, n):
    draw = random.Random(n)
    rows = [(draw.choice("ab"), draw.choice([draw.gauss(0, 1), 0.5, float(draw.randint(0, 3))])) for _ in range(n)] + [(None, 1.0), (None, 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = [0.0, 0.05, 0.1, 0.5, 0.9, 1.0]
    got = {r.g: tuple(r[f"q{k}"] for k in range(len(qs))) for r in quantiles(df, ["g"], "x", qs).collect()}
    want = {r.g: tuple(r.q) for r in df.where("x is not null").groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, qs))).alias("q")).collect()}
    assert got.keys() == want.keys()
    for g, values in want.items():
        assert got[g] == pytest.approx(values, abs=1e-12)


def test_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    assert tuple(quantiles(df, [], "x", [0.5]).first()) == (2, 2.0)
    assert quantiles(df.where("false"), [], "x", [0.5]).where("n > 0").count() == 0


def test_flag_shares(spark):
    df = spark.createDataFrame([(True, None), (False, None), (None, None), (True, True)], "a boolean, b boolean")
    assert {tuple(r) for r in panel.flag_shares(df, ["a", "b"]).collect()} == {("a", 3, 1, 2 / 3), ("b", 1, 3, 1.0)}
