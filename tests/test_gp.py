"""Gaussian process: closed forms, brute force, invariants."""

import math

import numpy as np
import pytest

from gapseries.operators import gp
from gapseries.operators.series import build_series
from tests import gp_plain as plain


def one(t, v, sigma2, alpha, tau, kernel="rq"):
    ll, mean, scale = gp.log_likelihood_batch(t[None], v[None], sigma2, alpha, tau, kernel)
    return ll[0], mean[0], scale[0]


def predicted(t, v, xs, sigma2, alpha, tau, kernel="rq"):
    mu, var = gp.predict_batch(t[None], v[None], xs[None], sigma2, alpha, tau, kernel)
    return mu[0], var[0]


def test_single_point_log_likelihood():
    ll, mean, scale = one(np.array([0.0]), np.array([5.0]), 0.05, 3.5, 1.25)
    assert abs(ll - (-0.5 * math.log(2 * 0.05) - 0.5 * math.log(2 * math.pi))) < 1e-12
    assert abs(ll - 0.232354) < 1e-6 and mean == 5.0 and scale == 1.0


def test_constant_series_predicts_the_constant():
    t = np.array([0.0, 1.0, 2.0])
    mu, var = predicted(t, np.array([4.0, 4.0, 4.0]), np.linspace(-2, 4, 9), 0.05, 3.5, 1.25)
    assert np.allclose(mu, 4.0) and np.all(var > 0)


def test_mean_independent_of_sigma2_and_variance_bounded():
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 10, 12))
    v = rng.normal(50, 10, 12)
    xs = np.linspace(-2, 12, 30)
    out = []
    for s2 in (0.05, 0.5, 1.9):
        mu, var = predicted(t, v, xs, s2, 2.0, 0.8)
        scale = one(t, v, s2, 2.0, 0.8)[2]
        assert np.all(var >= -1e-9) and np.all(var <= s2 * scale * scale + 1e-9)
        out.append(mu)
    assert np.allclose(out[0], out[1]) and np.allclose(out[0], out[2])


@pytest.mark.parametrize("kernel", gp.KERNELS)
@pytest.mark.parametrize("chunk", [64 << 20, 700])
def test_batches_match_one_series_at_a_time(monkeypatch, kernel, chunk):
    """Whatever the chunk size, on the series and on the grid axis."""
    monkeypatch.setattr(gp, "CHUNK_BYTES", chunk)
    rng = np.random.default_rng(11)
    T = np.sort(rng.uniform(0, 8, (5, 6)), axis=1)
    V = rng.normal(3, 2, (5, 6))
    V[2] = 7.0  # constant series: scale floor
    X = np.sort(rng.uniform(-1, 9, (5, 13)), axis=1)
    ll, mean, scale = gp.log_likelihood_batch(T, V, 0.05, 3.5, 1.25, kernel)
    mu, var = gp.predict_batch(T, V, X, 0.05, 3.5, 1.25, kernel)
    for k in range(5):
        L, w, llk, mk, sk = plain.fit(T[k], V[k], 0.05, 3.5, 1.25, kernel)
        assert abs(ll[k] - llk) < 1e-10 and abs(mean[k] - mk) < 1e-12 and abs(scale[k] - sk) < 1e-12
        muk, vark = plain.predict(T[k], L, w, X[k], 0.05, 3.5, 1.25, mk, sk, kernel)
        assert np.allclose(mu[k], muk) and np.allclose(var[k], vark)
    alphas, taus = np.array([0.5, 1.0, 3.5, 2.0]), np.array([0.3, 1.25, 2.0, 0.7])
    q, ld = gp.grid_terms_batch(T, V, alphas, taus, kernel)
    for s2 in (0.05, 1.0):
        for j in range(4):
            total = -q[j] / (2 * s2) - 15 * math.log(s2) - ld[j] / 2 - 15 * math.log(2 * math.pi)
            want = sum(plain.fit(T[k], V[k], s2, alphas[j], taus[j], kernel)[2] for k in range(5))
            assert abs(total - want) < 1e-8


def test_equal_instants_stay_positive_definite():
    t = np.array([0.0, 1.0, 1.0, 2.5])
    v = np.array([1.0, 2.0, 2.2, 0.5])
    assert np.isfinite(one(t, v, 0.05, 3.5, 1.25)[0])
    mu, var = predicted(t, v, np.array([1.0]), 0.05, 3.5, 1.25)
    assert np.all(var >= 0) and np.isfinite(mu).all()


def test_unknown_kernel():
    with pytest.raises(ValueError):
        gp.unit_kernel(np.zeros(1), 1.0, 1.0, "x")


def test_grid_values_count_and_accumulate():
    assert len(gp.grid_values(0.05, 2.0, 0.075)) == 27
    assert len(gp.grid_values(0.05, 4.0, 0.075)) == 53
    assert len(gp.grid_values(0.2, 2.0, 0.075)) == 25
    acc = gp.grid_values(0.05, 4.0, 0.075, accumulate=True)
    assert acc[46] == 3.5000000000000027


def _series(spark, rows):
    return spark.createDataFrame(rows, "k int, tw array<double>, v array<double>").repartition(3)


def _random_rows():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(6):
        n = 3 + k
        t = np.sort(rng.uniform(0, 6, n))
        rows.append((k, [float(x) for x in t], [float(x) for x in rng.normal(10, 3, n)]))
    return rows


@pytest.mark.parametrize("kernel,work", [("rq", 5e9), ("se", 5e9), ("rq", 100.0)])
def test_spark_grid_search_matches_brute_force(spark, monkeypatch, kernel, work):
    monkeypatch.setattr(gp, "WORK", work)  # a low bound hands every series out in parts
    rows = _random_rows()
    arr = _series(spark, rows)
    grid = dict(sigma2=(0.05, 0.2, 0.075), alpha=(0.5, 1.5, 0.5), tau=(0.5, 1.0, 0.25))
    lls = gp.gp_grid_search(arr, **grid, kernel=kernel, partitions=4).collect()
    assert len(lls) == (3 * 3 * 3 if kernel == "rq" else 3 * 3)
    for r in lls:
        brute = sum(plain.fit(np.array(t), np.array(v), r.sigma2, r.alpha, r.tau, kernel)[2] for _, t, v in rows)
        assert abs(r.log_likelihood - brute) < 1e-8 * max(1, abs(brute))
        assert r.n_series == 6 and r.n_points == sum(len(t) for _, t, _ in rows)
    best = gp.grid_argmax(spark.createDataFrame(lls), **grid).first()
    assert best.log_likelihood == max(r.log_likelihood for r in lls)
    per = gp.gp_log_likelihood(arr, ["k"], best.sigma2, best.alpha, best.tau, kernel=kernel).collect()
    assert abs(sum(r.log_likelihood for r in per) - best.log_likelihood) < 1e-8


def test_long_series_is_split_over_tasks(spark):
    """One series of thousands of points among short ones: its grid is dealt out in rows."""
    n = 3000
    rows = _random_rows() + [(99, [float(i) for i in range(n)], [float(i % 7) for i in range(n)])]
    arr = _series(spark, rows)
    grid = dict(alphas=[1.0, 2.0], taus=[0.5, 1.0])
    terms = gp.gp_grid_terms(arr, **grid, partitions=6).collect()
    with_long = [r for r in terms if r.n_points >= n]
    assert len(with_long) >= 3  # pairs of the long series come from several tasks
    assert sum(r.n_series for r in terms) == 4 * len(rows)


def test_non_finite_series_fails(spark):
    rows = [(1, [0.0, 1.0], [1.0, float("nan")]), (2, [0.0, 1.0], [1.0, 2.0])]
    with pytest.raises(Exception, match="non-finite"):
        gp.gp_grid_terms(_series(spark, rows), [1.0], [1.0]).collect()


def test_resample_grid_and_values(spark):
    rows = _random_rows() + [(7, [0.0, 1.0, 3.0], [1.0, 2.0, 0.5])]
    res = gp.gp_resample(_series(spark, rows), ["k"], 0.05, 3.5, 1.25, step=0.25, padding_length=20).collect()
    seven = sorted((r.i, r.t_warped) for r in res if r.k == 7)
    assert len(seven) == 33 and seven[0][1] == -2.5 and seven[-1][1] == 5.5
    for k, t, v in rows:
        own = sorted((r for r in res if r.k == k), key=lambda r: r.i)
        L, w, _, m, s = plain.fit(np.array(t), np.array(v), 0.05, 3.5, 1.25)
        mu, var = plain.predict(np.array(t), L, w, np.array([r.t_warped for r in own]), 0.05, 3.5, 1.25, m, s)
        assert np.allclose([r.mean for r in own], mu) and np.allclose([r.variance for r in own], var)


def test_length_limit_is_an_argument(spark):
    df = spark.createDataFrame([(1, float(i), float(i), float(i)) for i in range(20)],
                               "k int, t_rel double, t_warped double, v double")
    assert len(build_series(df, ["k"], "v").first().v) == 20
    with pytest.raises(Exception, match="max_points"):
        build_series(df, ["k"], "v", max_points=10).collect()


def test_tie_keeps_its_type_and_null_keys_stay(spark):
    rows = [(1, 0.0, 2 ** 53 + 1, "b", 5.0), (1, 0.0, 2 ** 53, "a", 1.0), (None, 0.0, 1, "z", 2.0)]
    df = spark.createDataFrame(rows, "k int, t_rel double, tie long, name string, v double").selectExpr(
        "*", "t_rel AS t_warped")
    for tie in ("tie", "name"):
        for parts in (None, 3):
            got = {r.k: r.v for r in build_series(df, ["k"], "v", tie=tie, partitions=parts).collect()}
            assert got == {1: [1.0, 5.0], None: [2.0]}
