"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every record scores each shard with a hash of (key, shard) and goes to the
best.  A shard's score depends on nothing but the key, the shard and its
weight, so a new shard takes records only into itself and the others keep
theirs.  Law: ``key`` (key and shard weights decide).

Cases: a null key hashes like the empty text; a null text counts no bytes
(CRC-32 0); rows that repeat a key share its shard and follow each other; an
empty table gives no rows.  Only columns and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapseries.llm.common import free_name, global_row_number, id_hash, materialize

SIZE_OVERHEAD = 16
KEY_BITS = 52


def rendezvous(key: Column, weights: dict[int, float], seed: int = 42) -> Column:
    """The shard (a key of ``weights``) that wins ``key``.

    With u uniform in (0, 1), -ln(u) / weight is least for a shard with a
    chance in proportion to its weight; equal weights need no logarithm.
    """
    key = F.coalesce(key.cast("string"), F.lit(""))
    equal = len(set(weights.values())) == 1
    scored = []
    for shard, weight in weights.items():
        h = id_hash(seed, key, F.lit(shard))
        score = h if equal else -F.log((h + F.lit(1.0)) / F.lit(2.0 ** KEY_BITS + 1)) / F.lit(float(weight))
        scored.append(F.struct(score.alias("score"), F.lit(shard).alias("shard")))
    if len(scored) == 1:
        return scored[0]["shard"]
    return F.least(*scored)["shard"]


def assign_shards(docs: DataFrame, weights: dict[int, float], *, grown: dict[int, float] | None = None,
                  key_col: str = "doc_id", text_col: str = "text", seed: int = 42,
                  keep: list[str] | None = None) -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard (the shard under ``grown``).

    ``slot`` numbers a shard's records from 0 without gaps, by hashed key, then
    text_crc32 and size (records alike in these may change places).  ``keep`` names the input columns to carry (default: all);
    an added column whose name the input has gets a leading underscore.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    out = {n: free_name(n, keep) for n in
           ("size", "text_crc32", "law", "shard", "slot", "grown_shard")}
    key, text = F.col(key_col), F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    grown_shard = rendezvous(key, grown, seed) if grown else F.lit(None).cast("int")
    # The carried columns travel in one struct, so their names cannot clash.
    # Written once, as finding the ranges of the order reads the rows a second time.
    rows = materialize(docs.select(
        F.struct(*keep).alias("kept"),
        (F.octet_length(text) + F.lit(SIZE_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(key, weights, seed).alias("shard"), grown_shard.alias("grown_shard"),
        id_hash(seed, F.coalesce(key.cast("string"), F.lit(""))).alias("h"),
        F.monotonically_increasing_id().alias("uid")), "shard-rows")
    return _number(rows).select(*[F.col("kept")[c].alias(c) for c in keep],
                                *[F.col(n).alias(out[n]) for n in out])


def _number(rows: DataFrame) -> DataFrame:
    """Add ``slot``: the place of each row among its shard's, by (h, text_crc32, size).

    All rows are numbered in one order over range partitions, whose bounds fall
    inside a key with very many copies like anywhere else; a shard's slots count
    from its first row.
    """
    order = [F.col(c).asc() for c in ("shard", "h", "text_crc32", "size", "uid")]
    placed = global_row_number(rows, order, "place")
    # One row for each shard.
    first = placed.groupBy(F.col("shard").alias("s")).agg(F.min("place").alias("first"))
    return (placed.join(F.broadcast(first), F.col("shard") == F.col("s"))
            .withColumn("slot", F.col("place") - F.col("first")))
