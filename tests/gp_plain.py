"""One-series Gaussian process in plain NumPy, the tests' reference."""

import math

import numpy as np


def unit(d2, alpha, tau, kernel="rq"):
    if kernel == "se":
        return np.exp(-d2 / (2 * tau * tau))
    return np.power(1 + d2 / (2 * alpha * tau * tau), -alpha)


def fit(t, v, sigma2, alpha, tau, kernel="rq"):
    """Cholesky factor, weights K^-1 y, log likelihood, mean, scale."""
    mean = v.mean()
    dev = math.sqrt(((v - mean) ** 2).sum())
    scale = dev if dev > 1e-8 else 1.0
    y, n = (v - mean) / scale, len(t)
    K = sigma2 * (unit((t[:, None] - t[None, :]) ** 2, alpha, tau, kernel) + np.eye(n))
    L = np.linalg.cholesky(K)
    w = np.linalg.solve(K, y)
    ll = -0.5 * y @ w - np.log(np.diag(L)).sum() - 0.5 * n * math.log(2 * math.pi)
    return L, w, ll, mean, scale


def predict(t, L, w, xs, sigma2, alpha, tau, mean, scale, kernel="rq"):
    ks = sigma2 * unit((t[:, None] - xs[None, :]) ** 2, alpha, tau, kernel)
    vv = np.linalg.solve(L, ks)
    return ks.T @ w * scale + mean, (sigma2 - (vv * vv).sum(axis=0)) * scale * scale
