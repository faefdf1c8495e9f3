"""A hot series holding most rows: exact results, spread over tasks."""

import numpy as np
from pyspark.sql import functions as F

from gapseries.operators import series as se


def plain_warp(times, a=3.0, b=0.0):
    gaps = np.diff(np.array(times) - times[0])
    return np.r_[0.0, np.cumsum(gaps ** (1 / a) + b)]


def _skewed():
    rng = np.random.default_rng(3)
    series = {0: np.sort(rng.uniform(0, 70, 20000))}
    for k in range(1, 30):
        series[k] = np.sort(rng.uniform(0, 20, 12))
    return series


def test_hot_series_is_spread_and_exact(spark):
    series = _skewed()
    rows = [(k, i, float(t), 1.0) for k, times in series.items() for i, t in enumerate(times)]
    pts = spark.createDataFrame(rows, "k int, tie int, t_days double, v double")
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        warped = se.time_warp(pts, ["k"], tie="tie")
        spread = (warped.where(F.col("k") == 0).select(F.spark_partition_id().alias("p"))
                  .distinct().count())
        assert spread >= 4
        got = {(r.k, r.tie): r.t_warped for r in warped.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)
    want = {(k, i): t for k, times in series.items() for i, t in enumerate(plain_warp(times))}
    assert got.keys() == want.keys()
    assert max(abs(got[key] - want[key]) for key in want) < 1e-8


def _burst(n=6000):
    rng = np.random.default_rng(8)
    series = {0: np.sort(np.r_[rng.uniform(5.0, 5.0 + 1 / 24, n), rng.uniform(0, 30, 40)]),  # most in one hour
              1: np.sort(rng.uniform(0, 20, 12)), None: np.sort(np.r_[[3.5] * 900, rng.uniform(3, 4, 900)])}
    rows = [(k, i, float(t), 1.0) for k, times in series.items() for i, t in enumerate(times)]
    return series, rows


def test_a_burst_is_spread_and_exact(spark):
    """Nearly all points of a series in one hour; another with half its points at one instant."""
    series, rows = _burst()
    pts = spark.createDataFrame(rows, "k int, tie int, t_days double, v double").repartition(5)
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        warped = se.time_warp(pts, ["k"], tie="tie", block_points=500)
        sizes = [r["count"] for r in warped.where("k = 0").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)
        got = {(r.k, r.tie): r.t_warped for r in warped.collect()}
        gaps = {(r.k, r.tie): r.dt for r in
                se.time_deltas(pts, ["k"], "t_days", "tie", block_points=500).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)
    want = {(k, i): t for k, times in series.items() for i, t in enumerate(plain_warp(times))}
    assert got.keys() == want.keys() and max(abs(got[key] - want[key]) for key in want) < 1e-8
    for k, times in series.items():
        assert gaps[k, 0] is None and all(abs(gaps[k, i] - d) < 1e-12 for i, d in enumerate(np.diff(times), 1))


def test_cut_points_are_of_even_counts(spark):
    _, rows = _burst()
    df = spark.createDataFrame(rows, "k int, tie int, t_days double, v double")
    df = df.withColumn(se._KEY, F.struct("k")).withColumn(se._BLK, F.floor("t_days").cast("long"))
    cuts = {(r._key.k, r._blk): r._cuts for r in se._bursts(df, "t_days", 500).collect()}
    assert set(cuts) == {(0, 5), (None, 3)}
    times = np.array([t for k, _, t, _ in rows if k == 0 and 5 <= t < 6])
    held = np.diff(np.r_[0, np.searchsorted(np.sort(times), cuts[0, 5], side="left"), len(times)])
    assert len(held) >= 100 and held.max() < 4 * len(times) / 128
    assert se._bursts(df, "t_days", 10_000) is None
