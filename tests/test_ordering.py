"""Running sums and places over range partitions, and series that one side lacks."""

from pyspark.sql import functions as F

from gapseries.operators.metrics import ranking_auc
from gapseries.operators.ordering import order_series, running_total, with_position
from gapseries.operators.overlay import overlay_missing


def test_running_total_and_position(spark):
    rows = [(i * 37 % 101, i % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, w int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        got = {r.k: r.s for r in running_total(df, [F.col("k").asc()], "w", "s").collect()}
        placed = {r.k: r.position for r in with_position(df, [F.col("k").desc()]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    weights = dict(rows)
    assert got == {k: sum(w for x, w in weights.items() if x < k) for k in weights}
    assert placed == {k: 101 - k for k in range(101)}
    assert running_total(df.where("1 = 0"), [F.col("k").asc()], "w", "s").collect() == []


def test_order_of_series_puts_nulls_first(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", None), ("a", 1), ("a", 1), (None, None)], "x string, y int")
    got = [(r.x, r.y) for r in order_series(df, ["x", "y"]).orderBy("position").collect()]
    assert got == [(None, None), (None, 2), ("a", None), ("a", 1), ("b", 1)]


def test_auc_over_several_ranges_with_ties(spark):
    rows = [(i * 7 % 40 / 10.0, int(i * i % 3 == 0)) for i in range(300)] + [(None, 1), (None, 0)]
    pairs = [((-1 if a is None else a) > (-1 if b is None else b)) + 0.5 * (a == b)
             for a, x in rows if x for b, y in rows if not y]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking_auc(spark.createDataFrame(rows, "s double, y int").repartition(5), "s", "y").first().auc
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert abs(got - sum(pairs) / len(pairs)) < 1e-12


def test_series_that_one_side_lacks(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, u string")
    right = spark.createDataFrame([(2, None), (3, "d"), (None, "a")], "k int, u string")
    got = sorted((tuple(r) for r in overlay_missing(left, right, ["k", "u"]).collect()), key=str)
    assert got == sorted([(1, "a", "resampled"), (3, "c", "resampled"), (3, "d", "series"), (None, "a", "series")], key=str)
