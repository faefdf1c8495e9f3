"""Table sources and sinks.

CSV validity is decided once: Spark's DROPMALFORMED mode judges a row only on
the columns a query happens to read, so two queries over the same file can
see different rows.  :func:`read_table_csv` therefore parses every column in
PERMISSIVE mode with a corrupt-record column, keeps the valid rows, and (by
default) lands them as Parquet in the shared checkpoint folder; every later
query reads that Parquet copy.  At scale this is the usual CSV -> Parquet
landing step anyway: columnar, splittable, with pushdown.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapseries.session import scratch_path

CORRUPT = "_corrupt_record"


def read_table_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   header: bool = True, land_at: str | None = None,
                   materialize: bool = True, partitions: int | None = None) -> DataFrame:
    """Read a CSV file or a directory of part files (``.csv`` or ``.csv.gz``).

    With a ``schema``, rows whose fields do not parse as the declared types
    are dropped, decided on all columns at once.  Without one every column is
    a string.  ``materialize`` writes the valid rows to ``land_at`` (default: a
    fresh folder under the checkpoint directory) and returns a Parquet read of
    it, so all later queries see exactly the same rows.  ``partitions`` deals
    the rows out before they are landed; a gzip file is read by one task, which
    would otherwise write one large file.
    """
    reader = spark.read.option("header", header)
    if schema is None:
        return reader.csv(path)
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    raw = (reader.schema(full).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    valid = raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if not materialize:
        return valid
    if partitions:
        valid = valid.repartition(partitions)
    target = land_at or scratch_path(spark, "csv-landing")
    valid.write.mode("overwrite").parquet(target)
    return spark.read.schema(schema).parquet(target)


def load_tables(spark: SparkSession, directory: str, schemas: Mapping[str, T.StructType],
                suffix: str = ".csv.gz", **kw) -> dict[str, DataFrame]:
    """Load several declared tables ``<directory>/<NAME><suffix>``."""
    if suffix.endswith(".gz"):
        kw.setdefault("partitions", int(spark.conf.get("spark.sql.shuffle.partitions")))
    return {name: read_table_csv(spark, os.path.join(directory, f"{name}{suffix}"), schema, **kw)
            for name, schema in schemas.items()}


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: list[str] | None = None, compression: str | None = None) -> None:
    """Write a table (Parquet or CSV with header), overwriting by default.

    Every task writes its own part file; nothing is funnelled through one task.
    ``compression`` names a codec of the format ("gzip" for ``.csv.gz`` parts).
    """
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'csv'")


def save_series(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Persist series (long or nested form) between stages as Parquet."""
    save_table(df, path, "parquet", "overwrite", partition_by)


def load_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


HYPERPARAMS_SCHEMA = T.StructType([
    T.StructField("sigma2", T.DoubleType()), T.StructField("alpha", T.DoubleType()),
    T.StructField("tau", T.DoubleType()), T.StructField("log_likelihood", T.DoubleType()),
    T.StructField("item_code", T.StringType())])


def save_hyperparams(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the hyperparameter row(s): sigma2, alpha, tau, log_likelihood, item_code."""
    save_table(df.select(*[f.name for f in HYPERPARAMS_SCHEMA.fields]), path, fmt)


def load_hyperparams(spark: SparkSession, path: str, item_code: str | None = None,
                     fmt: str = "csv"):
    """The hyperparameters for ``item_code`` (or the best row) as a Row."""
    df = (read_table_csv(spark, path, HYPERPARAMS_SCHEMA, materialize=False) if fmt == "csv"
          else spark.read.parquet(path))
    if item_code is not None:
        df = df.where(F.col("item_code") == item_code)
    row = df.orderBy(F.col("log_likelihood").desc_nulls_last(), "sigma2", "alpha", "tau").first()
    if row is None:
        raise ValueError(f"no hyperparameters in {path}" + (f" for {item_code}" if item_code else ""))
    return row
