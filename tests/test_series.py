"""Series operators: warp, grid, nested round trip, stats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapseries.operators import series as se
from gapseries.roles import Roles
from tests.test_skew import plain_warp


def _pts(spark, times, key=1):
    return spark.createDataFrame([(key, i, float(t), float(i)) for i, t in enumerate(times)],
                                 "k int, tie int, t_days double, v double")


def test_warp_cube_roots(spark):
    w = se.time_warp(_pts(spark, [0, 1, 9, 9]), ["k"], tie="tie", a=3.0, b=0.0)
    got = [r.t_warped for r in w.orderBy("tie").collect()]
    assert np.allclose(got, [0, 1, 3, 3])


def test_warp_one_point_and_offset(spark):
    w = se.time_warp(_pts(spark, [5.0]), ["k"], tie="tie")
    assert [r.t_warped for r in w.collect()] == [0.0]
    w = se.time_warp(_pts(spark, [2, 3, 11]), ["k"], tie="tie", a=3.0, b=0.5)
    got = [r.t_warped for r in w.orderBy("tie").collect()]
    assert np.allclose(got, [0, 1.5, 4.0])
    assert [r.t_rel for r in w.orderBy("tie").collect()] == [0.0, 1.0, 9.0]


def test_warp_is_monotone_and_starts_at_zero(spark):
    rng = np.random.default_rng(1)
    times = np.sort(rng.uniform(0, 50, 40))
    w = se.time_warp(_pts(spark, times), ["k"], tie="tie").orderBy("tie").collect()
    tw = [r.t_warped for r in w]
    assert tw[0] == 0.0 and all(b >= a for a, b in zip(tw, tw[1:]))


def test_regular_grid(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.3), (1, 3.0)], "k int, t_warped double")
    g = se.regular_grid(df, ["k"], step=0.25, padding_length=20).orderBy("i").collect()
    assert len(g) == 33 and g[0].t_warped == -2.5 and g[-1].t_warped == 5.5


def test_build_and_flatten_round_trip(spark):
    pts = se.time_warp(_pts(spark, [3, 1, 2]), ["k"], tie="tie")
    nested = se.build_series(pts, ["k"], "v", tie="tie")
    r = nested.first()
    assert list(r.t) == [0.0, 1.0, 2.0] and list(r.v) == [1.0, 2.0, 0.0]
    flat = se.flatten_series(nested, ["k"], value="v")
    assert flat.count() == 3


def test_build_series_max_points_raises(spark):
    pts = se.time_warp(_pts(spark, list(range(10))), ["k"], tie="tie")
    import pytest
    with pytest.raises(Exception):
        se.build_series(pts, ["k"], "v", tie="tie", max_points=5).collect()


def test_series_stats(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 3.0)], "k int, t double, v double")
    r = se.series_stats(df, ["k"], "t", "v").first()
    assert (r.n, r.t_min, r.t_max, r.span, r.mean) == (2, 0.0, 2.0, 2.0, 2.0)
    assert abs(r.l2_dev - np.sqrt(2.0)) < 1e-12


def test_epoch_days_floors_milliseconds(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:07.179575",)], "s string").select(
        F.to_timestamp_ntz("s").alias("ts"))
    from gapseries.functions.columns import epoch_days
    v = df.select(epoch_days(df, "ts").alias("d")).first().d
    assert v == 1704067207179 / 86400000.0


def _points(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in (0, 1, None):
        times = np.sort(rng.uniform(0, 60, 50 + 20 * (k or 2)))
        rows += [(k, i, float(t), float(i)) for i, t in enumerate(times)]
    rows += [(9, 0, 3.0, 1.0), (9, 1, 3.0, 2.0), (9, 2, 30.0, 3.0)]  # equal instants
    return rows, spark.createDataFrame(rows, "k int, tie int, t_days double, v double")


@pytest.mark.parametrize("block", [0.5, 1.0, 7.0, 1000.0])
def test_warp_and_deltas_whatever_the_block(spark, block):
    """Against NumPy; a null key is a series like any other."""
    rows, pts = _points(spark)
    for a, b in ((3.0, 0.0), (2.0, 0.25)):
        got = {(r.k, r.tie): (r.t_rel, r.t_warped)
               for r in se.time_warp(pts, ["k"], tie="tie", a=a, b=b, block_days=block).collect()}
        assert len(got) == len(rows)
        for k in (0, 1, 9, None):
            times = [r[2] for r in rows if r[0] == k]
            for i, (t, w) in enumerate(zip(times, plain_warp(times, a, b))):
                assert abs(got[k, i][0] - (t - times[0])) < 1e-9 and abs(got[k, i][1] - w) < 1e-9
    dt = {(r.k, r.tie): r.dt for r in se.time_deltas(pts, ["k"], t="t_days", tie="tie", block_days=block).collect()}
    rel = {(r.k, r.tie): r.t_rel for r in se.relative_time(pts, ["k"]).collect()}
    for k in (0, 1, 9, None):
        times = [r[2] for r in rows if r[0] == k]
        assert dt[k, 0] is None and np.allclose([dt[k, i] for i in range(1, len(times))], np.diff(times))
        assert np.allclose([rel[k, i] for i in range(len(times))], np.array(times) - times[0])


def test_warp_series_filter(spark):
    pts = spark.createDataFrame([(k, i, float(i), 0.0) for k in (0, 1, None) for i in range(4)],
                                "k int, tie int, t_days double, v double")
    keep = spark.createDataFrame([(1,), (None,), (1,)], "k int")
    got = se.time_warp(pts, ["k"], tie="tie", block_days=1.5, series_filter=keep)
    assert sorted(map(str, {r.k for r in got.collect()})) == ["1", "None"] and got.count() == 8


def test_nan_counts_as_null(spark):
    roles = Roles(entity="k", item="k", time="ts", value="v", subject=None, unit=None, tie=None, category="k")
    df = spark.createDataFrame([(1, "2024-01-01", 1.0), (1, "2024-01-02", float("nan")), (1, "2024-01-03", None)],
                               "k int, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert [r.v for r in se.to_points(df, roles).collect()] == [1.0]
    assert sorted(r.v for r in se.to_points(df, roles, null_values="zero").collect()) == [0.0, 0.0, 1.0]
