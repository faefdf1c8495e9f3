"""Gaussian-process operators over nested series (one row per series).

A series enters as parallel arrays (``tw`` times, ``v`` values) built by
:func:`gapseries.operators.series.build_series`.  The arithmetic runs in
``mapInPandas`` on Arrow batches: Spark partitions and shuffles the series, a
task sees a batch of whole series and factorises them with NumPy.

Model (noise equal to the signal variance):
  y   = (v - mean(v)) / l2_dev,  l2_dev = sqrt(sum (v - mean)^2), 1 if <= 1e-8
  K   = sigma2 * R + sigma2 * I
  R_ij = (1 + d_ij^2 / (2 alpha tau^2)) ^ -alpha   rational quadratic ("rq")
       = exp(-d_ij^2 / (2 tau^2))                  squared exponential ("se")
  ll  = -y' K^-1 y / 2 - sum log diag chol(K) - n log(2 pi) / 2
Prediction at x*: mean = k*' K^-1 y * l2_dev + mean(v),
                  variance = (sigma2 - k*' K^-1 k*) * l2_dev^2  (noise not added).

Because K = sigma2 (R + I), ll separates:
  ll = -q / (2 sigma2) - (n/2) log sigma2 - logdet(R + I) / 2 - (n/2) log 2 pi,
  q = y' (R + I)^-1 y.
The grid search therefore factorises once per (alpha, tau) and sums three
numbers per series; the sigma2 axis is expanded afterwards in columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapseries.functions.columns import grid_values  # noqa: F401  (re-exported)

LOG_2PI = math.log(2.0 * math.pi)
STD_FLOOR = 1e-8
# Bytes of stacked n x n matrices a task builds at once (one matrix at least).
CHUNK_BYTES = 64 * 1024 * 1024

# The hyperparameter grid of the original search
# (sigma2 0.05..2.0, alpha 0.05..4.0, tau 0.2..2.0, all by 0.075).
DEFAULT_SIGMA2 = (0.05, 2.0, 0.075)
DEFAULT_ALPHA = (0.05, 4.0, 0.075)
DEFAULT_TAU = (0.2, 2.0, 0.075)


# ------------------------------------------------------------- NumPy core ---
# Every function takes a block of m equal-length series as rows of T and V.

KERNELS = ("rq", "se")


def unit_kernel(d2: np.ndarray, alpha, tau, kernel: str = "rq") -> np.ndarray:
    """R of squared distances: rational quadratic, or squared exponential (no alpha)."""
    if kernel == "rq":
        return np.exp(-alpha * np.log1p(d2 / (2.0 * alpha * tau * tau)))
    if kernel == "se":
        return np.exp(-d2 / (2.0 * tau * tau))
    raise ValueError(f"kernel must be one of {KERNELS}")


def standardise_rows(V: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row-wise centred and scaled values, means and scales of an (m, n) block."""
    mean = V.mean(axis=1)
    dev = np.sqrt(((V - mean[:, None]) ** 2).sum(axis=1))
    scale = np.where(dev > STD_FLOOR, dev, 1.0)
    return (V - mean[:, None]) / scale[:, None], mean, scale


def _unit_plus_identity(T: np.ndarray, alphas: np.ndarray, taus: np.ndarray, kernel: str) -> np.ndarray:
    """R + I for m series and g (alpha, tau) pairs: (m, g, n, n).

    R is symmetric with a unit diagonal, so only the strict upper triangle is
    evaluated.
    """
    m, n = T.shape
    iu, ju = np.triu_indices(n, 1)
    d2 = (T[:, iu] - T[:, ju]) ** 2                                   # (m, p)
    upper = unit_kernel(d2[:, None, :], alphas[None, :, None], taus[None, :, None], kernel)
    M = np.empty((m, len(alphas), n, n))
    M[..., iu, ju] = upper
    M[..., ju, iu] = upper
    di = np.arange(n)
    M[..., di, di] = 2.0
    return M


def _forward_solve(L: np.ndarray, Y: np.ndarray) -> np.ndarray:
    """Solve L Z = Y for stacked lower-triangular L (..., n, n), Y (..., n, r).

    n vectorised steps of O(n r) each, instead of a general LU solve.
    """
    n = L.shape[-1]
    Z = np.empty(L.shape[:-2] + Y.shape[-2:])
    Yb = np.broadcast_to(Y, Z.shape)
    for i in range(n):
        acc = (L[..., i:i + 1, :i] @ Z[..., :i, :])[..., 0, :] if i else 0.0
        Z[..., i, :] = (Yb[..., i, :] - acc) / L[..., i, i, None]
    return Z


def _factor(T: np.ndarray, V: np.ndarray, sigma2: float, alpha: float, tau: float, kernel: str):
    """Cholesky factors of K = sigma2 (R + I), L^-1 y, means and scales."""
    Y, mean, scale = standardise_rows(V)
    M = _unit_plus_identity(T, np.array([alpha]), np.array([tau]), kernel)[:, 0]
    L = np.linalg.cholesky(sigma2 * M)
    return L, _forward_solve(L, Y[..., None]), mean, scale


def _block_rows(n: int, extra: int = 0) -> int:
    """Series of n points whose n x n (and n x extra) matrices fit CHUNK_BYTES."""
    return max(1, CHUNK_BYTES // (8 * n * (n + extra)))


def log_likelihood_batch(T: np.ndarray, V: np.ndarray, sigma2: float, alpha: float, tau: float,
                         kernel: str = "rq") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, mean and scale of m equal-length series."""
    m, n = T.shape
    out = np.empty((3, m))
    rows = _block_rows(n)
    for s in range(0, m, rows):
        L, z, mean, scale = _factor(T[s:s + rows], V[s:s + rows], sigma2, alpha, tau, kernel)
        ll = (-0.5 * (z * z).sum(axis=(1, 2)) - np.log(np.diagonal(L, axis1=1, axis2=2)).sum(axis=1)
              - 0.5 * n * LOG_2PI)
        out[:, s:s + rows] = ll, mean, scale
    return out[0], out[1], out[2]


def predict_batch(T: np.ndarray, V: np.ndarray, X: np.ndarray, sigma2: float, alpha: float,
                  tau: float, kernel: str = "rq") -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of m equal-length series at the rows of X (m, g).

    With w = L^-1 k*, the mean is w' L^-1 y and the variance sigma2 - w' w.
    """
    m, n = T.shape
    g = X.shape[1]
    mu, var = np.empty((m, g)), np.empty((m, g))
    rows = _block_rows(n)
    for s in range(0, m, rows):
        L, z, mean, scale = _factor(T[s:s + rows], V[s:s + rows], sigma2, alpha, tau, kernel)
        width = max(1, CHUNK_BYTES // (8 * n * len(L)))
        for c in range(0, g, width):
            x = X[s:s + rows, c:c + width]
            ks = sigma2 * unit_kernel((T[s:s + rows, :, None] - x[:, None, :]) ** 2, alpha, tau, kernel)
            w = _forward_solve(L, ks)
            mu[s:s + rows, c:c + width] = (w * z).sum(axis=1) * scale[:, None] + mean[:, None]
            var[s:s + rows, c:c + width] = (sigma2 - (w * w).sum(axis=1)) * (scale * scale)[:, None]
    return mu, var


def grid_terms_batch(T: np.ndarray, V: np.ndarray, alphas: np.ndarray, taus: np.ndarray,
                     kernel: str = "rq") -> tuple[np.ndarray, np.ndarray]:
    """q = y'(R+I)^-1 y and logdet(R+I) summed over m equal-length series, for
    every (alpha, tau) pair; series x pairs are stacked up to ``CHUNK_BYTES``."""
    Y, _, _ = standardise_rows(V)
    m, n = T.shape
    g = len(alphas)
    q, logdet = np.zeros(g), np.zeros(g)
    pairs = min(g, _block_rows(n))
    rows = max(1, _block_rows(n) // pairs)
    for c in range(0, g, pairs):
        for s in range(0, m, rows):
            L = np.linalg.cholesky(_unit_plus_identity(T[s:s + rows], alphas[c:c + pairs],
                                                       taus[c:c + pairs], kernel))
            z = _forward_solve(L, Y[s:s + rows, None, :, None])
            q[c:c + pairs] += (z * z).sum(axis=(0, 2, 3))
            logdet[c:c + pairs] += 2.0 * np.log(np.diagonal(L, axis1=2, axis2=3)).sum(axis=(0, 2))
    return q, logdet


def _by_length(ts, vs):
    """Group parallel arrays of series by length: {n: (indices, T, V)}."""
    groups: dict[int, list[int]] = {}
    arrs = [np.asarray(t, float) for t in ts]
    for i, t in enumerate(arrs):
        groups.setdefault(len(t), []).append(i)
    out = {}
    for n, idx in groups.items():
        out[n] = (idx, np.stack([arrs[i] for i in idx]),
                  np.stack([np.asarray(vs[i], float) for i in idx]))
    return out


def grid_count(lo: float, hi: float, step: float) -> int:
    return int(math.floor(round((hi - lo) / step, 9))) + 1


# ------------------------------------------------------------ Spark level ---

def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def param_grid(spark, sigma2=DEFAULT_SIGMA2, alpha=DEFAULT_ALPHA, tau=DEFAULT_TAU,
               accumulate: bool = False) -> DataFrame:
    """All (sigma2, alpha, tau) combinations as a DataFrame (a generator, not a
    join): ``grid_id``, sigma2, alpha, tau."""
    s, a, t = (grid_values(*r, accumulate=accumulate) for r in (sigma2, alpha, tau))
    df = spark.range(1).select(
        F.explode(F.array(*[F.lit(x) for x in s])).alias("sigma2"))
    df = df.withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in a])))
    df = df.withColumn("tau", F.explode(F.array(*[F.lit(x) for x in t])))
    return df.withColumn("grid_id", F.monotonically_increasing_id()).select(
        "grid_id", "sigma2", "alpha", "tau")


def gp_log_likelihood(series: DataFrame, keys: Sequence[str], sigma2: float, alpha: float,
                      tau: float, t: str = "tw", v: str = "v", kernel: str = "rq",
                      long_points: int | None = None) -> DataFrame:
    """Per series: n, mean, l2_dev and the log marginal likelihood.

    Series of more than ``long_points`` points are factorised in tiles, so that
    no task holds their matrix (the same numbers; see ``gp_tiles``).
    """
    if long_points is not None:
        from gapseries.operators.gp_tiles import tiled_log_likelihood
        return gp_log_likelihood(series.where(F.size(t) <= long_points), keys, sigma2, alpha, tau, t, v, kernel) \
            .unionByName(tiled_log_likelihood(series.where(F.size(t) > long_points), keys, sigma2, alpha, tau,
                                              t, v, kernel))
    schema = T.StructType(_key_fields(series, keys) + [
        T.StructField("n", T.IntegerType()), T.StructField("mean", T.DoubleType()),
        T.StructField("l2_dev", T.DoubleType()), T.StructField("log_likelihood", T.DoubleType())])
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # series of equal length are factorised together (one stacked call)
            for length, (idx, T_, V_) in _by_length(b[t].values, b[v].values).items():
                lls, means, scales = log_likelihood_batch(T_, V_, sigma2, alpha, tau, kernel)
                out = {k: b[k].values[idx] for k in keys}
                out.update(n=np.full(len(idx), length, dtype="int32"), mean=means, l2_dev=scales,
                           log_likelihood=lls)
                yield pd.DataFrame(out)

    return series.select(*keys, t, v).mapInPandas(run, schema)


def gp_resample_arrays(series: DataFrame, keys: Sequence[str], sigma2: float, alpha: float,
                       tau: float, step: float = 0.25, padding_length: float = 20.0,
                       t: str = "tw", v: str = "v", kernel: str = "rq",
                       long_points: int | None = None) -> DataFrame:
    """The GP on the grid ``min-pad .. max+pad by step``, one row per series:
    keys, ``t0`` (first grid time), ``mean`` and ``variance`` (arrays over the grid).
    ``long_points`` as in :func:`gp_log_likelihood`."""
    if step <= 0:
        raise ValueError("step must be positive")
    if long_points is not None:
        from gapseries.operators.gp_tiles import tiled_resample_arrays
        return gp_resample_arrays(series.where(F.size(t) <= long_points), keys, sigma2, alpha, tau, step,
                                  padding_length, t, v, kernel).unionByName(
            tiled_resample_arrays(series.where(F.size(t) > long_points), keys, sigma2, alpha, tau, step,
                                  padding_length, t, v, kernel))
    pad = padding_length * step / 2.0
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType(_key_fields(series, keys) + [
        T.StructField("t0", T.DoubleType()), T.StructField("mean", doubles),
        T.StructField("variance", doubles)])
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, (idx, T_, V_) in _by_length(b[t].values, b[v].values).items():
                lo = T_.min(axis=1) - pad
                size = [grid_count(x, y + pad, step) for x, y in zip(lo, T_.max(axis=1))]
                # Blocks of series of like grid length, so that little is padded.
                order = np.argsort(size, kind="stable")
                rows = _block_rows(n, max(size))
                for s in range(0, len(order), rows):
                    own = order[s:s + rows]
                    X = lo[own, None] + np.arange(max(size[i] for i in own))[None, :] * step
                    mu, var = predict_batch(T_[own], V_[own], X, sigma2, alpha, tau, kernel)
                    at = np.asarray(idx)[own]
                    out = {k: b[k].values[at] for k in keys}
                    out.update(t0=lo[own], mean=[mu[r, :size[i]] for r, i in enumerate(own)],
                               variance=[var[r, :size[i]] for r, i in enumerate(own)])
                    yield pd.DataFrame(out)

    return series.select(*keys, t, v).mapInPandas(run, schema)


def flatten_resampled(arrays: DataFrame, keys: Sequence[str], step: float = 0.25,
                      out_t: str = "t_warped") -> DataFrame:
    """:func:`gp_resample_arrays` as long rows: keys, i, ``out_t``, mean, variance."""
    grid = F.posexplode(F.arrays_zip("mean", "variance")).alias("i", "_g")
    return arrays.select(*keys, "t0", grid).select(
        *keys, F.col("i").cast("int").alias("i"),
        (F.col("t0") + F.col("i") * F.lit(step)).alias(out_t),
        F.col("_g.mean").alias("mean"), F.col("_g.variance").alias("variance"))


def gp_resample(series: DataFrame, keys: Sequence[str], sigma2: float, alpha: float,
                tau: float, step: float = 0.25, padding_length: float = 20.0,
                t: str = "tw", v: str = "v", out_t: str = "t_warped", kernel: str = "rq") -> DataFrame:
    """Resample every series onto ``min-pad .. max+pad by step`` with the GP
    mean and variance; long output: keys, i, ``out_t``, mean, variance."""
    arrays = gp_resample_arrays(series, keys, sigma2, alpha, tau, step, padding_length, t, v, kernel)
    return flatten_resampled(arrays, keys, step, out_t)


# Multiplications that one row of grid work should hold at most; a longer
# series is handed out as several rows, each with a part of the grid.
WORK = 5e9


def gp_grid_terms(series: DataFrame, alphas: Sequence[float], taus: Sequence[float],
                  t: str = "tw", v: str = "v", kernel: str = "rq",
                  partitions: int | None = None, long_points: int | None = None) -> DataFrame:
    """Partial sums per (alpha, tau): sum q, sum logdet, points, series.
    ``long_points`` as in :func:`gp_log_likelihood`.

    Each task emits one row per grid pair for all the series it holds, so the
    shuffle after it carries (tasks x grid) rows whatever the number of series.
    A series of n points costs n^3 / 3 for each pair: the pairs of a long
    series are split over rows, which are dealt out to tasks on their own.
    """
    if long_points is not None:
        from gapseries.operators.gp_tiles import tiled_grid_terms
        return gp_grid_terms(series.where(F.size(t) <= long_points), alphas, taus, t, v, kernel, partitions) \
            .unionByName(tiled_grid_terms(series.where(F.size(t) > long_points), alphas, taus, t, v, kernel))
    ag, tg = np.meshgrid(np.asarray(alphas, float), np.asarray(taus, float), indexing="ij")
    af, tf = ag.ravel(), tg.ravel()
    g = len(af)
    schema = T.StructType([T.StructField("alpha", T.DoubleType()), T.StructField("tau", T.DoubleType()),
                           T.StructField("q", T.DoubleType()), T.StructField("logdet", T.DoubleType()),
                           T.StructField("n_points", T.LongType()),
                           T.StructField("n_series", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, ld = np.zeros(g), np.zeros(g)
        npts, nser = np.zeros(g, dtype="int64"), np.zeros(g, dtype="int64")
        for b in batches:
            for (part, parts), rows in b.groupby(["part", "parts"]):
                own = slice(part * g // parts, (part + 1) * g // parts)
                for length, (idx, T_, V_) in _by_length(rows[t].values, rows[v].values).items():
                    qi, li = grid_terms_batch(T_, V_, af[own], tf[own], kernel)
                    q[own] += qi
                    ld[own] += li
                    npts[own] += length * len(idx)
                    nser[own] += len(idx)
        if not (np.isfinite(q).all() and np.isfinite(ld).all()):
            raise ValueError("a series has a non-finite value or time; its likelihood is undefined")
        if nser.any():
            yield pd.DataFrame({"alpha": af, "tau": tf, "q": q, "logdet": ld,
                                "n_points": npts, "n_series": nser})[nser > 0]

    parts = F.least(F.lit(g), F.greatest(F.lit(1), F.ceil(F.pow(F.size(t), F.lit(3)) * F.lit(g / 3.0 / WORK))))
    work = series.select(t, v, parts.cast("int").alias("parts"))
    work = work.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    if partitions:
        work = work.repartition(partitions)
    return work.mapInPandas(run, schema)


def gp_grid_search(series: DataFrame, sigma2=DEFAULT_SIGMA2, alpha=DEFAULT_ALPHA,
                   tau=DEFAULT_TAU, accumulate: bool = False, t: str = "tw",
                   v: str = "v", kernel: str = "rq", partitions: int | None = None,
                   long_points: int | None = None) -> DataFrame:
    """Summed log likelihood of every grid point over all series.
    ``long_points`` as in :func:`gp_log_likelihood`.

    Output: sigma2, alpha, tau, log_likelihood, n_series, n_points.  The
    squared exponential has no alpha: its grid has the single alpha 1.
    """
    s_vals = grid_values(*sigma2, accumulate=accumulate)
    a_vals = grid_values(*alpha, accumulate=accumulate) if kernel == "rq" else [1.0]
    t_vals = grid_values(*tau, accumulate=accumulate)
    terms = gp_grid_terms(series, a_vals, t_vals, t, v, kernel, partitions, long_points)
    sums = terms.groupBy("alpha", "tau").agg(
        F.sum("q").alias("q"), F.sum("logdet").alias("logdet"),
        F.sum("n_points").alias("n_points"), F.sum("n_series").alias("n_series"))
    s2 = F.col("sigma2")
    n = F.col("n_points").cast("double")
    ll = (-F.col("q") / (2.0 * s2) - n / 2.0 * F.log(s2) - F.col("logdet") / 2.0
          - n / 2.0 * F.lit(LOG_2PI))
    return (sums.withColumn("sigma2", F.explode(F.array(*[F.lit(x) for x in s_vals])))
            .select("sigma2", "alpha", "tau", ll.alias("log_likelihood"), "n_series", "n_points"))


def grid_argmax(lls: DataFrame, sigma2=DEFAULT_SIGMA2, alpha=DEFAULT_ALPHA,
                tau=DEFAULT_TAU) -> DataFrame:
    """The grid point of highest likelihood (ties: smallest parameters), with
    a flag telling whether it lies on the edge of the grid."""
    best = lls.orderBy(F.col("log_likelihood").desc(), "sigma2", "alpha", "tau").limit(1)
    edge = F.lit(False)
    for c, (lo, hi, step) in (("sigma2", sigma2), ("alpha", alpha), ("tau", tau)):
        last = lo + (grid_count(lo, hi, step) - 1) * step
        edge = edge | (F.abs(F.col(c) - F.lit(lo)) < 1e-9) | (F.abs(F.col(c) - F.lit(last)) < 1e-9)
    return best.withColumn("at_grid_edge", edge)
