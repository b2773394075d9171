"""Order statistics and percentiles of groups against sorted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import profiling, quantiles, timeseries


@pytest.fixture
def rows():
    rng = random.Random(5)
    out = [("far", v) for v in [*(rng.random() for _ in range(60)), 1e9, 1e18, -1e300]]
    out += [("same", 4.0)] * 9 + [("one", -2.5), (None, 1.0), (None, 3.0), ("none", None)]
    out += [("ends", v) for v in (float("-inf"), 1.0, 2.0, 5.0, float("inf"), float("inf"))]
    return out + [("ties", float(rng.randrange(7))) for _ in range(50)]


def by_group(rows):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    return {g: sorted(v) for g, v in groups.items()}


def test_places(spark, rows):
    df = spark.createDataFrame(rows, "s string, x double").filter("x is not null").select(quantiles.group_key("s").alias("g"), F.col("x").alias("v"), "s")
    names = {r.g: r.s for r in df.select("g", "s").distinct().collect()}
    places = {"first": F.lit(0), "low": F.expr("n div 4"), "high": F.expr("3 * n div 4"), "last": F.expr("n - 1")}
    for levels in (0, 1, 2, 3):
        got = {names[r.g]: (r.n, r.first, r.low, r.high, r.last) for r in quantiles.at_places(df.select("g", "v"), places, levels).collect()}
        assert got == {g: (len(v), v[0], v[len(v) // 4], v[3 * len(v) // 4], v[-1]) for g, v in by_group(rows).items()}


def test_percentiles_and_their_callers(spark, rows):
    finite = [(g, v) for g, v in rows if g not in ("ends", "far")] + [("far", v) for v in (0.5, 1.0, 1.5, 2.0, 1e6)]
    df = spark.createDataFrame([(g, v, k) for k, (g, v) in enumerate(finite)], "s string, x double, k long")
    want = {g: np.percentile(v, [25, 50, 75]) for g, v in by_group(finite).items()}
    stats = {r.s: r for r in timeseries.statistics(df, "s", "x").collect()}
    assert set(stats) == {*want, "none"} and stats["none"].n == 0 and stats["none"].median is None
    for g, q in want.items():
        assert [stats[g].q25, stats[g].median, stats[g].q75] == pytest.approx(q, abs=1e-4)
    odd = {(r.s, r.x) for r in timeseries.iqr_anomalies(df, "s", "k", "x", 1.5).collect()}
    assert odd == {(g, v) for g, v in finite if g is not None and v is not None and not want[g][0] - 1.5 * (want[g][2] - want[g][0]) <= v <= want[g][2] + 1.5 * (want[g][2] - want[g][0])}
    got = {r.column: r for r in profiling.column_stats(df, ["x", "k"]).collect()}
    assert [got["k"].q25, got["k"].median, got["k"].q75] == pytest.approx(np.percentile(range(len(finite)), [25, 50, 75]))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "s string, k long, x double")
    assert quantiles.at_places(df.selectExpr("s AS g", "x AS v"), {"a": F.lit(0)}).count() == 0
    assert [(r.n, r.median) for r in profiling.column_stats(df, ["x"]).collect()] == [(0, None)]
    assert timeseries.statistics(df, "s", "x").count() == timeseries.iqr_anomalies(df, "s", "k", "x").count() == profiling.imputed(df, "k", "x", "s", "median").count() == 0
