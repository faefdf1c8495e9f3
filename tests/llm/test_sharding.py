"""Rendezvous shards against hashlib, growth, weights and slots."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from gapseries.llm import sharding
from tests.llm.helpers import DOCS, clashing, odd_docs, odd_rows


def h52(*parts):
    return int(hashlib.md5("|".join(["42", *map(str, parts)]).encode()).hexdigest()[:13], 16)


def plain_shard(key, weights):
    key = "" if key is None else key
    if len(set(weights.values())) == 1:
        return min(weights, key=lambda s: (h52(key, s), s))
    return min(weights, key=lambda s: -math.log((h52(key, s) + 1.0) / (2.0 ** 52 + 1)) / weights[s])


EQUAL = {s: 1.0 for s in range(40)}


def assigned(df, weights=EQUAL, **kw):
    return sharding.assign_shards(df, weights, **kw)


def check_slots(rows):
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


def test_odd_rows(spark):
    rows = assigned(odd_docs(spark), grown=EQUAL | {40: 1.0}, keep=["doc_id", "text"]).collect()
    want = sorted((str(d), plain_shard(d, EQUAL), plain_shard(d, EQUAL | {40: 1.0}),
                   len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in odd_rows())
    assert sorted((str(r.doc_id), r.shard, r.grown_shard, r.size, r.text_crc32) for r in rows) == want
    check_slots(rows)


@pytest.mark.parametrize("partitions", [1, 7])
def test_growth_and_slots(spark, partitions):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(
        spark.range(300).select(F.lit(5).alias("doc_id"), F.concat(F.lit("copy"), "id").alias("text")))  # a hot key
    rows = assigned(df.repartition(partitions), {s: 1.0 for s in range(8)},
                    grown={s: 1.0 for s in range(9)}).collect()
    check_slots(rows)
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(r.grown_shard == 8 for r in moved) and 300 < len(moved) < 900
    order = sorted((r.shard, h52(r.doc_id), r.text_crc32, r.size, r.slot) for r in rows)
    assert order == sorted(order, key=lambda x: (x[0], x[4]))


@pytest.mark.parametrize("copies", [4000, 6000])
def test_slots_of_a_hot_key_follow_the_text(spark, copies):
    """Whatever the number of copies, and over several ranges."""
    df = spark.range(copies).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).union(
        spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = assigned(df.repartition(5), {0: 1.0}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    check_slots(rows)
    hot = sorted((r.slot, r.text_crc32) for r in rows if r.doc_id == 7)
    assert [c for _, c in hot] == sorted(c for _, c in hot)


def test_weights(spark):
    weights = {0: 1.0, 1: 3.0}
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = assigned(df, weights).collect()
    assert [r.shard for r in rows] == [plain_shard(r.doc_id, weights) for r in rows]
    assert 0.7 < sum(r.shard for r in rows) / 3000 < 0.8
    assert {r.grown_shard for r in rows} == {None}


def test_empty_and_clashing(spark):
    assert assigned(spark.createDataFrame([], DOCS)).count() == 0
    df = clashing(odd_docs(spark))
    out = assigned(df)
    assert out.columns == [*df.columns, "_size", "text_crc32", "_law", "_shard", "_slot", "grown_shard"]
    assert out.where("slot = 'x-slot'").count() == df.count()


def test_one_shard(spark):
    assert {r.shard for r in assigned(odd_docs(spark), {3: 2.0}).collect()} == {3}


def test_no_python_on_executors(spark):
    plan = assigned(odd_docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
