"""The tiled factorisation against the dense one."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapseries.operators import gp
from gapseries.operators import gp_tiles as gt


def series(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in sizes.items():
        tw = np.sort(rng.uniform(0, 3 + n / 10, n))
        rows.append((k, tw.tolist(), (np.sin(tw) + 0.1 * rng.normal(size=n)).tolist()))
    return spark.createDataFrame(rows, "k int, tw array<double>, v array<double>")


@pytest.mark.parametrize("kernel", ["rq", "se"])
def test_log_likelihood(spark, kernel):
    """A long series among short ones, one shorter than a tile, one of a whole number of tiles, one point."""
    df = series(spark, {1: 230, 2: 7, None: 80, 4: 1, 5: 41})
    want = {r.k: r for r in gp.gp_log_likelihood(df, ["k"], 0.2, 1.5, 0.8, kernel=kernel).collect()}
    got = {r.k: r for r in gt.tiled_log_likelihood(df, ["k"], 0.2, 1.5, 0.8, kernel=kernel, tile=40).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert g.n == w.n and abs(g.mean - w.mean) < 1e-12 and abs(g.l2_dev - w.l2_dev) < 1e-9
        assert abs(g.log_likelihood - w.log_likelihood) < 1e-8 * max(1.0, abs(w.log_likelihood))


def test_resample(spark):
    df = series(spark, {1: 130, 2: 9, None: 50}, seed=3)
    want = {r.k: r for r in gp.gp_resample_arrays(df, ["k"], 0.3, 2.0, 1.1).collect()}
    got = {r.k: r for r in gt.tiled_resample_arrays(df, ["k"], 0.3, 2.0, 1.1, tile=32).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert abs(got[k].t0 - w.t0) < 1e-12 and len(got[k].mean) == len(w.mean)
        assert np.allclose(got[k].mean, w.mean, atol=1e-9) and np.allclose(got[k].variance, w.variance, atol=1e-9)


def test_a_task_holds_tiles_only(spark, monkeypatch):
    """No stored cell block exceeds a tile, and the setting that bounds batches is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    seen = []
    real = gt._factorise

    def watched(*args):
        tiles = real(*args)
        seen.append((tiles.agg(F.max(F.octet_length("cells"))).first()[0], tiles.count(), spark.conf.get(key)))
        return tiles

    monkeypatch.setattr(gt, "_factorise", watched)
    monkeypatch.setattr(gt, "BATCH_BYTES", 3 * 8 * 25 * 25)
    gt.tiled_log_likelihood(series(spark, {1: 100, 2: 60}), ["k"], 0.2, 1.0, 1.0, tile=25).collect()
    # 10 tiles and 4 of the values for four tiles a side; 6 and 3 for three.
    assert seen == [(8 * 25 * 25, 10 + 4 + 6 + 3, "3")] and spark.conf.get(key) == before


@pytest.mark.parametrize("budget", [1, 4, 7])  # steps of 1 or 2 panels, bands of 1, 2 or 3 block rows
def test_steps_and_bands(spark, monkeypatch, budget):
    """Series of several steps and bands beside ones that end with the first."""
    monkeypatch.setattr(gt, "BATCH_BYTES", 16 * 16 * 16 * budget)
    df = series(spark, {1: 75, 2: 5, None: 33}, seed=4)
    want = {r.k: r for r in gp.gp_resample_arrays(df, ["k"], 0.3, 2.0, 1.1).collect()}
    got = {r.k: r for r in gt.tiled_resample_arrays(df, ["k"], 0.3, 2.0, 1.1, tile=16).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert np.allclose(got[k].mean, w.mean, atol=1e-9) and np.allclose(got[k].variance, w.variance, atol=1e-9)
    want = {r.k: r.log_likelihood for r in gp.gp_log_likelihood(df, ["k"], 0.3, 2.0, 1.1).collect()}
    got = {r.k: r.log_likelihood for r in gt.tiled_log_likelihood(df, ["k"], 0.3, 2.0, 1.1, tile=16).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tiles_of_a_series_that_ends_at_once_are_not_dealt_out(spark, monkeypatch):
    """The plan that makes all tiles of short series has one exchange, of their points."""
    plans = []
    real = gt._factorise

    def watched(*args):
        tiles = real(*args)
        plans.append(tiles._jdf.queryExecution().sparkPlan().toString())
        return tiles

    monkeypatch.setattr(gt, "_factorise", watched)
    gt.tiled_resample_arrays(series(spark, {1: 30, 2: 12}), ["k"], 0.3, 2.0, 1.1, tile=8).collect()
    assert len(plans) == 1 and plans[0].count("Exchange") == 1 and "Join" not in plans[0]


def test_series_that_end_at_once_leave_no_tiles_and_fill_the_tasks(spark, monkeypatch):
    """Two numbers a short series, and tasks by the cores: the few bytes of points are much work."""
    seen = []
    real = gt._factorise

    def watched(*args):
        tiles = real(*args)
        seen.append((tiles.count(), tiles.where("cells is not null").count(), tiles.rdd.getNumPartitions()))
        return tiles

    monkeypatch.setattr(gt, "_factorise", watched)
    gt.tiled_log_likelihood(series(spark, {k: 10 + k % 9 for k in range(60)}), ["k"], 0.2, 1.0, 1.0, tile=8).collect()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    assert seen == [(120, 0, tasks)]


def test_a_step_keeps_what_later_ones_read(spark, monkeypatch):
    """A row a block row below the step's pivots, with the step's tiles side by side."""
    kept = []
    real = gt._factorise

    def watched(*args):
        tiles = real(*args)
        kept.extend((r.k, r.i, r.n) for r in tiles.where("cells is not null").select(
            "k", "i", F.octet_length("cells").alias("n")).collect())
        return tiles

    monkeypatch.setattr(gt, "_factorise", watched)
    monkeypatch.setattr(gt, "BATCH_BYTES", 16 * 16 * 16 * 4)  # steps of two panels
    gt.tiled_log_likelihood(series(spark, {1: 75}), ["k"], 0.2, 1.0, 1.0, tile=16).collect()
    tile = 8 * 16 * 32  # 16 rows of two panels; the last block row has 11 points, the values' has one
    assert sorted(kept) == [(1, 2, tile), (1, 3, tile), (1, 4, 8 * 11 * 32), (1, 5, 8 * 32),
                            (3, 4, 8 * 11 * 32), (3, 5, 8 * 32)]


def test_bands_of_one_shape_go_through_the_panels_as_one(monkeypatch):
    stacks = []
    real = gt._eliminate

    def watched(bands, *args):
        stacks.append(len(bands))
        return real(bands, *args)

    monkeypatch.setattr(gt, "_eliminate", watched)
    rng = np.random.default_rng(1)
    points = {s: (np.sort(rng.uniform(0, 9, n)), rng.normal(size=n)) for s, n in enumerate([11] * 30 + [5, 16])}
    rows = []
    for s, (x, y) in points.items():
        tiles = -(-len(x) // 8)
        for i in range(tiles):
            rows.append((s, 0, -1, i, gt.P, True, tiles, tiles + 1, 1.5, 0.8, 0, x[8 * i:8 * i + 8], y[8 * i:8 * i + 8], None))
        rows.append((s, 0, -1, tiles, gt.Y, True, tiles, tiles + 1, 1.5, 0.8, 0, [], [], None))
    kinds = [pa.int64(), *[pa.int32()] * 4, pa.bool_(), *[pa.int32()] * 2, *[pa.float64()] * 2, pa.int32(),
             *[pa.list_(pa.float64())] * 2, pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=gt._MET)
    run = gt._eliminated(0, 256, 0.2, "rq", gt.BATCH_BYTES, gt.STACK_BYTES)
    found = [r for b in run(iter([batch])) for r in b.to_pylist()]
    assert sorted(stacks) == [1, 1, 30] and len(found) == 2 * len(points)
    for s, (x, y) in points.items():
        k = 0.2 * (gp.unit_kernel((x[:, None] - x) ** 2, 1.5, 0.8) + np.eye(len(x)))
        terms = {r["kind"]: r["term"] for r in found if r["sid"] == s}
        assert abs(terms[gt.P] - np.linalg.slogdet(k)[1]) < 1e-9 and abs(terms[gt.Y] - y @ np.linalg.solve(k, y)) < 1e-9


def test_equal_times_and_constant_values(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 1.0, 1.0, 1.0], [2.0] * 5)], "k int, tw array<double>, v array<double>")
    want = gp.gp_log_likelihood(df, ["k"], 0.5, 1.0, 1.0).first()
    got = gt.tiled_log_likelihood(df, ["k"], 0.5, 1.0, 1.0, tile=2).first()
    assert abs(got.log_likelihood - want.log_likelihood) < 1e-10 and got.l2_dev == 1.0


def test_grid_terms_and_the_length_option(spark):
    df = series(spark, {1: 60, 2: 9, 3: 33}, seed=5)
    want = {(r.alpha, r.tau): r for r in gp.gp_grid_terms(df.coalesce(1), [0.5, 2.0], [0.7, 1.9]).collect()}
    rows = gt.tiled_grid_terms(df, [0.5, 2.0], [0.7, 1.9], tile=16).collect()
    assert len(rows) == len(want) == 4
    for r in rows:
        w = want[r.alpha, r.tau]
        assert (r.n_points, r.n_series) == (w.n_points, w.n_series) == (102, 3)
        assert abs(r.q - w.q) < 1e-9 and abs(r.logdet - w.logdet) < 1e-8
    kw = dict(sigma2=(0.1, 0.4, 0.3), alpha=(1.0, 2.0, 1.0), tau=(1.0, 1.0, 1.0))
    whole = {(r.sigma2, r.alpha): r.log_likelihood for r in gp.gp_grid_search(df, **kw).collect()}
    split = {(r.sigma2, r.alpha): r.log_likelihood for r in gp.gp_grid_search(df, **kw, long_points=20).collect()}
    assert whole.keys() == split.keys() and all(abs(whole[k] - split[k]) < 1e-8 for k in whole)
    dense = {r.k: r.mean for r in gp.gp_resample_arrays(df, ["k"], 0.3, 2.0, 1.1).collect()}
    mixed = {r.k: r.mean for r in gp.gp_resample_arrays(df, ["k"], 0.3, 2.0, 1.1, long_points=30).collect()}
    assert dense.keys() == mixed.keys() and all(np.allclose(dense[k], mixed[k], atol=1e-9) for k in dense)
    both = gp.gp_log_likelihood(df, ["k"], 0.3, 2.0, 1.1, long_points=30)
    assert sorted(r.k for r in both.collect()) == [1, 2, 3]


def test_empty(spark):
    df = series(spark, {1: 3}).where("k = 2")
    assert gt.tiled_log_likelihood(df, ["k"], 0.5, 1.0, 1.0).collect() == []
    assert gt.tiled_resample_arrays(df, ["k"], 0.5, 1.0, 1.0).collect() == []
