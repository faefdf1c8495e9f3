"""Plan helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pickle
import sys
import types

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapseries.session import scratch_path

# A word is a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    The reread table has fixed rows (row ids and partition ids survive a lost
    executor), a short lineage and prunes columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(base: str, taken) -> str:
    """``base``, with underscores added until no column of ``taken`` has the name."""
    lower = {c.lower() for c in taken}
    while base.lower() in lower:
        base = "_" + base
    return base


def crc_of_id(doc_id: Column | str) -> Column:
    """Unsigned CRC-32 of the id's text (0 for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0))


def word_count(text: Column | str) -> Column:
    """Number of words of a text, 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def id_hash(seed, *cols: Column) -> Column:
    """52 bits of an MD5 over ``seed`` and the columns (the same in any SQL engine)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's place (from 1) in the whole order, without one task sorting all.

    Rows are range-partitioned and written once; each partition is numbered on
    its own and shifted by the sizes of those before it (one row a partition).
    """
    pid = free_name("_pid", df.columns)
    dealt = materialize(df.repartitionByRange(*order).withColumn(pid, F.spark_partition_id()),
                        "ordered")
    sizes = dealt.groupBy(pid).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(pid, (F.sum("_n").over(Window.orderBy(pid)) - F.col("_n")).alias("_before"))
    # One row for each partition: bounded by spark.sql.shuffle.partitions.
    numbered = dealt.join(F.broadcast(before), pid)
    w = Window.partitionBy(pid).orderBy(*order)
    return (numbered.withColumn(name, F.row_number().over(w) + F.col("_before"))
            .drop(pid, "_before"))


def worker_state(name: str, make):
    """``make()`` once for each Python worker process; reused by its later tasks."""
    holder = sys.modules.get("_gapseries_worker_state")
    if holder is None:
        holder = sys.modules.setdefault("_gapseries_worker_state",
                                        types.ModuleType("_gapseries_worker_state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def text_rows(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The kept columns, and the text's place among them (added as the last if not kept)."""
    if text_col in keep and dict(docs.dtypes)[text_col] == "string":
        return docs.select(*keep), keep.index(text_col)
    return docs.select(*keep, F.col(text_col).cast("string").alias(free_name("_body", keep))), len(keep)


def text_batches(batches, at: int):
    """(batch, its texts as bytes) for each Arrow batch; memory goes back between batches."""
    for batch in batches:
        yield batch, batch.column(at).cast(pa.binary())
        pa.default_memory_pool().release_unused()


def share(spark: SparkSession, value):
    """Broadcast any value; a task gets it with ``shared``.

    Pickled by value, so executors need no installed copy of its class.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(held):
    return pickle.loads(held.value)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
