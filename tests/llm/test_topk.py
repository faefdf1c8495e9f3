"""Exact top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapseries.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k=5):
    use = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in use:
        if is_query(i):
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in use if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, every=10, **kw):
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **kw)
    return sorted(tuple(r) for r in got.collect())


def random_rows(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    scale = np.exp(-np.arange(dims) / 6)  # uneven mass, so that bounds cut
    return [(i, (rng.normal(size=dims) * scale * spread).tolist(), 0) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 16, 40])
def test_random(spark, dims):
    rows = random_rows(400, dims, dims)
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_blocks_of_queries_and_rows(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 7), ("ROWS", 30), ("GROUP", 4), ("DIM_BLOCK", 5)):
        monkeypatch.setattr(topk, name, value)
    rows = random_rows(300, 24, 5)
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    same = [0.5, 0.25]
    rows = [(0, same, 1), (1, same, 1), (2, same, None), (3, same, 1), (4, same, 1), (5, same, 1), (6, same, 1),
            (7, None, 1), (8, [0.1, None], 1), (9, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 1),
            (20, [9.0, 9.0], 1), (None, [9.0, 9.0], 1), (30, [1.0], 1), (40, [1.0, 2.0, 3.0], 1), (30, [1.0], 1),
            (2, same, None), (50, [], 1), (60, [], 1), (20, [1.0, -1.0], 1)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_large_components(spark):
    rows = [(i, [3e5 + i, -2e5 * i], 0) for i in range(30)]  # past what doubles hold exactly
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_fewer_than_k_and_empty(spark):
    assert run(spark, [(0, [1.0], 0), (1, [2.0], 0)]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(0, [1.0], 0)]) == []
    assert run(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame(random_rows(50, 8, 1), SCHEMA).withColumns(
        {n: F.lit(n) for n in ("score", "rank", "query_id", "v")})
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect()) == \
        brute(random_rows(50, 8, 1), lambda i: i % 10 == 0)
