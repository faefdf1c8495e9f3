"""Hard negatives against brute force, bounds, the Hilbert order and block choice."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapseries.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10, k=5):
    use = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows
           if i is not None and lab is not None and v is not None
           and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in use:
        if i % every == 0:
            anchors[i] = min((lab, v), anchors.get(i, (lab, v)))
    out = []
    for a, (lab, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in use if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == lab][:k]:
            near = [(t, i) for t, i, m in scored if m != lab and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(near)]
    return sorted(out)


def run(spark, rows, every=10, partitions=None):
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.repartition(partitions) if partitions else df
    return sorted(tuple(r) for r in hn.mine_hard_negatives(df, F.col("vec_id") % every == 0).collect())


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(8, dims)) * 3
    return [(i, (middle[i % 8] + rng.normal(size=dims) * 0.3).tolist(), int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 40])
def test_random(spark, dims):
    rows = clustered(400, dims, dims)
    want = brute(rows)
    assert want and run(spark, rows) == want


def test_small_blocks_batches_and_groups(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("BATCH", 30), ("GROUP", 3), ("RUNS", 2)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(300, 6, 5)
    assert run(spark, rows) == run(spark, rows, partitions=7) == brute(rows)


def test_odd_rows(spark):
    same = [0.5, 0.25]
    rows = [(0, same, 1), *((i, same, i % 3) for i in range(1, 9)), (9, None, 1), (11, [0.1, None], 1),
            (12, [float("nan"), 1.0], 1), (13, [float("inf"), 1.0], 1), (14, same, None), (None, same, 1),
            (20, [9.0, 9.0], 1), (20, [1.0, -1.0], 2), (30, [1.0], 1), (31, [2.0], 1), (32, [1.9], 2),
            (50, [], 1), (60, [], 1), (61, [], 2), (70, [-1.0, 0.0], 1), (3, same, 0), (3, same, 2)]
    assert run(spark, rows) == brute(rows)


def test_a_hot_vector_is_split(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 20)
    rows = [(i, [1.0, 2.0], i % 2) for i in range(200)] + clustered(100, 2, 1)[50:]
    assert run(spark, rows, every=50) == brute(rows, every=50)


def test_large_components(spark):
    rows = [(i, [3e5 + i, -2e5 * i], i % 2) for i in range(40)]  # past what doubles hold exactly
    assert run(spark, rows) == brute(rows)


def test_empty_and_alone(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 0)]) == []
    assert run(spark, [(0, [1.0], 0), (1, [1.0], 0), (2, [1.0], 1)]) == [(0, 1, 1, 2, 65536, 65536)]


def test_clashing_columns(spark):
    rows = clustered(60, 4, 2)
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {n: F.lit(n) for n in ("score", "rank", "anchor", "v", "block", "key", "place", "anchor_id")})
    got = hn.mine_hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (1, 4), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in hn.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_zone_bounds_hold():
    rng = np.random.default_rng(3)
    a, v = rng.integers(-50, 50, (20, 7)), rng.integers(-50, 50, (30, 7))
    least, most = hn.zone_bounds(a, v.min(axis=0)[None], v.max(axis=0)[None])
    score = a @ v.T
    assert (least[:, 0] <= score.min(axis=1)).all() and (score.max(axis=1) <= most[:, 0]).all()


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    """With vectors in clusters, an anchor's windows meet few blocks."""
    monkeypatch.setattr(hn, "BLOCK", 25)
    rows = [(i, v, lab) for i, v, lab in clustered(800, 3, 9)]
    seen = []
    runs = hn.Blocks.runs

    def watched(self, held):
        chosen = runs(self, held)
        if chosen is not None:
            seen.append((self.rows.where(chosen).count(), self.rows.count()))
        return chosen

    monkeypatch.setattr(hn.Blocks, "runs", watched)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = hn.mine_hard_negatives(df, F.col("vec_id") == 400)
    assert sorted(tuple(r) for r in got.collect()) == [x for x in brute(rows, every=400) if x[0] == 400]
    assert len(seen) == 2 and all(read <= whole / 3 for read, whole in seen), seen
