"""Series in chunks: places, halos, patches across borders, hot series."""

import random

import pytest
from pyspark.sql import functions as F

from gapseries.operators import patches as pa
from gapseries.operators import series as se


def _points(spark, sizes):
    rows = [(k, "u", i, float(i // 2), None if i % 7 == 3 else float(10 * i)) for k, m in sizes.items() for i in range(m)]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, "k int, u string, tie int, t_rel double, v double")


SIZES = {1: 23, 2: 5, 3: 1, None: 11, 4: 10}
KEYS = ["k", "u"]


def test_positions_count_from_zero_in_each_series(spark):
    got = se.series_positions(_points(spark, SIZES), KEYS, tie="tie").collect()
    assert len(got) == sum(SIZES.values())
    assert all(r.pos == r.tie for r in got)
    assert se.series_positions(_points(spark, SIZES).where("1 = 0"), KEYS, tie="tie").count() == 0


@pytest.mark.parametrize("size, halo", [(5, 0), (5, 4), (5, 12), (1, 1), (100, 3)])
def test_chunks_hold_their_points_and_the_halo(spark, size, halo):
    placed = se.series_positions(_points(spark, SIZES), KEYS, tie="tie")
    chunks = se.chunk_series(placed, KEYS, ["tie", "v"], size, halo)
    got = {(r.k, r.chunk): (r["at"], r.tie, r.v) for r in chunks.collect()}
    want = {}
    for k, m in SIZES.items():
        for c in range(-(-m // size)):
            at = list(range(c * size, min(m, (c + 1) * size + halo)))
            want[(k, c)] = (c * size, at, [None if i % 7 == 3 else 10.0 * i for i in at])
    assert got == want
    flat = se.flatten_chunks(chunks, KEYS, ["tie", "v"], size).collect()
    assert sorted((str(r.k), r.pos, r.tie, r.v is None) for r in flat) == sorted(
        (str(k), i, i, i % 7 == 3) for k, m in SIZES.items() for i in range(m))


@pytest.mark.parametrize("include_last", [False, True])
@pytest.mark.parametrize("size, length", [(5, 5), (5, 12), (3, 1), (50, 6)])
def test_patches_cross_chunk_borders(spark, size, length, include_last):
    rows = [(k, i, float(i), float(-i)) for k, m in SIZES.items() for i in range(m)]
    grid = spark.createDataFrame(rows, "k int, i int, mean double, variance double")
    arrays = spark.createDataFrame(
        [(k, [float(i) for i in range(m)], [float(-i) for i in range(m)]) for k, m in SIZES.items()],
        "k int, mean array<double>, variance array<double>")
    halo = length - 1 if include_last else length
    chunks = se.chunk_series(grid, ["k"], ["mean", "variance"], size, halo, pos="i")
    got = pa.extract_chunk_patches(chunks, ["k"], length, size, include_last=include_last).collect()
    want = pa.extract_patches(arrays, ["k"], length, include_last=include_last).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_hot_series_is_many_bounded_rows_in_many_tasks(spark):
    hot = spark.range(60_000).select(
        F.when(F.col("id") < 50_000, 0).otherwise(F.col("id").cast("int")).alias("k"), F.lit("u").alias("u"),
        F.col("id").alias("tie"), F.lit(1.0).alias("t_rel"), F.col("id").cast("double").alias("v"))
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = se.chunk_series(se.series_positions(hot, KEYS, tie="tie"), KEYS, ["v"], 1000, 5)
        own = chunks.where("k = 0").select(F.size("v").alias("n"), F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)
    assert sorted(r.n for r in own) == [1000] + [1005] * 49
    assert len({r.p for r in own}) >= 4


def test_sizes_are_checked(spark):
    with pytest.raises(ValueError):
        se.chunk_series(_points(spark, SIZES), KEYS, ["v"], 0)
    with pytest.raises(ValueError):
        se.chunk_series(_points(spark, SIZES), KEYS, ["v"], 5, -1)
