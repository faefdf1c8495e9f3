"""Hash sampling: exact quotas, stability under repartitioning, splits."""

import hashlib

from pyspark.sql import functions as F

from gapseries.operators import sampling as sa


def _h(seed, *parts):
    s = "|".join([str(seed)] + [str(p) for p in parts])
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16)


def test_key_hash_matches_md5(spark):
    from gapseries.functions.columns import key_hash
    df = spark.createDataFrame([(5, "x")], "a int, b string")
    assert df.select(key_hash(["a", "b"], 7).alias("h")).first().h == _h(7, 5, "x")


def test_keep_smallest_by_hash_is_exact(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "k int, g int")
    for bits in (1, 4, 16):
        got = sorted(r.k for r in sa.keep_smallest_by_hash(df, ["k"], 37, seed=3, bits=bits).collect())
        want = sorted(range(500), key=lambda k: (_h(3, k), k))[:37]
        assert got == sorted(want)


def test_balance_classes_hash(spark):
    rows = [(i, "a") for i in range(40)] + [(100 + i, "b") for i in range(15)]
    df = spark.createDataFrame(rows * 2, "k int, c string")  # two points per series
    bal = sa.balance_classes(df, ["k", "c"], "c", classes=["a", "b"], seed=1)
    counts = {r.c: r.n_series for r in sa.class_counts(bal, ["k", "c"], "c").collect()}
    assert counts == {"a": 15, "b": 15} and bal.count() == 60
    empty = sa.balance_classes(df.where("c = 'a'"), ["k", "c"], "c", classes=["a", "b"])
    assert empty.count() == 0


def test_split_is_stable_under_repartition(spark):
    df = spark.createDataFrame([(i, "u") for i in range(1000)], "k int, unit string")
    a = {r.k: r.split for r in sa.split_series(df, ["k", "unit"], 0.7, 74565).collect()}
    b = {r.k: r.split for r in sa.split_series(df.repartition(7), ["k", "unit"], 0.7, 74565).collect()}
    assert a == b
    frac = sum(v == "train" for v in a.values()) / len(a)
    assert 0.65 < frac < 0.75


def test_sample_series_exact(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(300)], "s int, x int")
    got = sa.sample_series(df, ["s"], 10, seed=2)
    assert got.select("s").distinct().count() == 10 and got.count() == 30
    assert got.where(F.col("s").isNull()).count() == 0


def test_bernoulli_balancing_is_seeded_and_reduces(spark):
    rows = [(i, "a") for i in range(400)] + [(1000 + i, "b") for i in range(100)]
    df = spark.createDataFrame(rows, "k int, c string")
    a = sa.balance_classes(df, ["k", "c"], "c", method="bernoulli", seed=5)
    b = sa.balance_classes(df, ["k", "c"], "c", method="bernoulli", seed=5)
    ca = {r.c: r.n_series for r in sa.class_counts(a, ["k", "c"], "c").collect()}
    assert ca["b"] == 100 and 60 <= ca["a"] <= 140
    assert sorted(r.k for r in a.collect()) == sorted(r.k for r in b.collect())


def test_poisson_patch_sampling_draws_with_replacement(spark):
    from gapseries.operators.patches import choose_patches
    counts = spark.createDataFrame([(s, 50) for s in range(10)], "k int, n_patches int")
    got = choose_patches(counts, ["k"], multiple=3, seed=1, method="poisson")
    assert 5 <= got.count() <= 70


def test_rows_of_a_null_label_stay(spark):
    """A label without a quota keeps everything, null included."""
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "k int, c string")
    got = sa.keep_smallest_by_hash(df, ["k"], {"a": 1}, label="c").collect()
    assert len(got) == 3 and sorted(r.k for r in got if r.c is None) == [3, 4]
    assert len(sa.keep_smallest_by_hash(df, ["k"], {"a": 2, None: 1}, label="c").collect()) == 3


def test_bernoulli_balancing_ignores_the_layout(spark):
    df = spark.createDataFrame([(k, "a" if k % 4 else "b") for k in range(400)], "k int, c string")
    first = {r.k for r in sa.balance_classes(df.repartition(1), ["k", "c"], "c", method="bernoulli", seed=5).collect()}
    again = {r.k for r in sa.balance_classes(df.repartition(9), ["k", "c"], "c", method="bernoulli", seed=5).collect()}
    assert first == again and all(k in first for k in range(0, 400, 4))
    assert 60 < len(first) - 100 < 140


def test_draws_with_replacement(spark):
    from collections import Counter

    from gapseries.operators.patches import choose_patches
    counts = spark.createDataFrame([(1, 100), (2, 1), (3, 0), (None, 49), (4, 50)], "k int, n_patches int")
    draws = [sorted((str(r.k), r.start, r.draw) for r in
                    choose_patches(counts.repartition(n), ["k"], multiple=500, seed=1, method="replacement").collect())
             for n in (1, 5)]
    assert draws[0] == draws[1] and len(draws[0]) == 2000 and len({d for *_, d in draws[0]}) == 2000
    share = Counter(k for k, *_ in draws[0])
    assert "3" not in share and 850 < share["1"] < 1150 and 400 < share["None"] < 580 and 1 <= share["2"] < 30
    starts = Counter(s for k, s, _ in draws[0] if k == "1")
    assert set(starts) == set(range(100))
    assert choose_patches(counts.where("n_patches = 0"), ["k"], method="replacement").collect() == []


def test_draws_of_each_label(spark):
    from gapseries.operators.patches import draw_patches
    counts = spark.createDataFrame([(i, "a" if i < 30 else "b", 1 + i % 7) for i in range(40)],
                                   "k int, c string, n_patches int")
    got = draw_patches(counts, ["k", "c"], 3, 0, label="c").collect()
    assert sum(r.c == "a" for r in got) == 90 and sum(r.c == "b" for r in got) == 30
    assert all(r.start <= r.k % 7 and (r.c == "a") == (r.k < 30) for r in got)


def test_a_hot_series_among_many_tiny_ones(spark):
    from gapseries.operators.patches import draw_patches
    counts = spark.range(2000).selectExpr("id AS k", "IF(id = 7, 4000, 1) AS n_patches")
    got = draw_patches(counts, ["k"], 1, 3).collect()
    assert len(got) == 2000 and 1200 < sum(r.k == 7 for r in got) < 1450
