"""Role mapping of the driver's generated tables (no clinical data needed).

| role            | table                      | mapping                                  |
| events (series) | events                     | entity=user_id, item=event_type, ts, value, tie=event_id, unit='' |
| events (sparse) | orders                     | entity=o_custkey, item=o_orderpriority, ts=o_orderdate, value=o_totalprice |
| events (matrix) | lineitem x orders x part   | entity=o_custkey, item=p_brand            |
| item dimension  | distinct event_type/p_brand| item_code = upper(event_type) / substr(p_brand, 7) |
| diagnoses       | orders                     | code = priority digit, status, '-', orderkey mod 10; category = first 2 chars |

Every adapter returns the same role names (entity, item, ts, value, unit,
event_id, code, category, item_code) so the same operators run on all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapseries.roles import Roles
from gapseries.schemas import TABLES

ROLES = Roles(entity="entity", item="item", time="ts", value="value", subject=None,
              unit="unit", tie="event_id", category="category")
MIXED_ROLES = ROLES.with_(subject="subject")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense series: about 13 points per (user, event type)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("item"),
                    "ts", "value", F.lit("").alias("unit"), "event_id")


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item dimension of ``events``: item, item_code."""
    return (table(spark, sf_dir, "events").select(F.col("event_type").alias("item")).distinct()
            .withColumn("item_code", F.upper("item")))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse series: orders per (customer, priority)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("item"),
                    F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"),
                    F.lit("").alias("unit"), F.col("o_orderkey").alias("event_id"))


def mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with several units and subjects per pair, and nulls and NaN among them."""
    o = table(spark, sf_dir, "orders")
    key, none = F.col("o_orderkey"), F.lit(None)
    value = (F.when(key % 11 == 0, none.cast("double")).when(key % 13 == 0, F.lit(float("nan")))
             .otherwise(F.col("o_totalprice").cast("double")))
    return o.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("item"),
                    F.when(key % 4 == 0, none.cast("string")).otherwise((key % 3).cast("string")).alias("subject"),
                    F.when(key % 5 == 0, none.cast("string")).otherwise(F.col("o_orderstatus")).alias("unit"),
                    F.col("o_orderdate").alias("ts"), value.alias("value"), key.alias("event_id"))


def priority_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item dimension of the orders: item, item_code; the first priority has two codes."""
    code = F.substring("item", 1, 1)
    codes = F.when(code == "1", F.array(code, F.lit("U"))).otherwise(F.array(code))
    return (table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("item")).distinct()
            .select("item", F.explode(codes).alias("item_code")))


def brand_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: (entity = customer, item = part brand)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(p, li.l_partkey == p.p_partkey)
            .select(F.col("o_custkey").alias("entity"), F.col("p_brand").alias("item")))


def brand_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item dimension of ``brand_events``: item, item_code."""
    return (table(spark, sf_dir, "part").select(F.col("p_brand").alias("item")).distinct()
            .withColumn("item_code", F.substring("item", 7, 100)))


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis rows derived from orders: entity, code, category."""
    o = table(spark, sf_dir, "orders")
    code = F.concat(F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"), F.lit("-"),
                    (F.col("o_orderkey") % 10).cast("string"))
    return (o.select(F.col("o_custkey").alias("entity"), code.alias("code"))
            .withColumn("category", F.substring("code", 1, 2)))


def clinical(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The test tables as rows of the declared clinical schemas, by table name."""
    null = F.lit(None)
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    item = F.length("event_type")
    rows = {
        "LABEVENTS": e.select(
            F.col("event_id").alias("ROW_ID"), F.col("user_id").alias("SUBJECT_ID"), F.col("user_id").alias("HADM_ID"),
            item.alias("ITEMID"), F.col("ts").cast("timestamp").alias("CHARTTIME"),
            F.col("event_type").alias("VALUE"), F.col("value").alias("VALUENUM"),
            F.when(item % 2 == 0, F.lit("mg, dL")).alias("VALUEUOM"), null.alias("FLAG")),
        "D_LABITEMS": e.groupBy("event_type").agg(F.min("event_id").alias("ROW_ID")).select(
            "ROW_ID", item.alias("ITEMID"), F.col("event_type").alias("LABEL"), F.lit("Blood").alias("FLUID"),
            null.alias("CATEGORY"), F.upper("event_type").alias("LOINC_CODE")),
        "PATIENTS": table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("ROW_ID"), F.col("c_custkey").alias("SUBJECT_ID"),
            F.substring("c_mktsegment", 1, 1).alias("GENDER"), *[null.alias(c) for c in ("DOB", "DOD", "DOD_HOSP", "DOD_SSN")],
            F.lit("0").alias("EXPIRE_FLAG")),
        "DIAGNOSES_ICD": o.select(
            F.col("o_orderkey").alias("ROW_ID"), F.col("o_custkey").alias("SUBJECT_ID"),
            F.col("o_custkey").alias("HADM_ID"), (F.col("o_orderkey") % 7).alias("SEQ_NUM"),
            F.concat(F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)).alias("ICD9_CODE")),
        "D_ICD_DIAGNOSES": table(spark, sf_dir, "nation").select(
            F.col("n_nationkey").alias("ROW_ID"), F.col("n_regionkey").cast("string").alias("ICD9_CODE"),
            F.col("n_name").alias("SHORT_TITLE"), null.alias("LONG_TITLE")),
    }
    return {name: df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields])
            for name, df in rows.items()}


# SQL twins of the adapters, for the DuckDB oracle (same names, same values).
SQL_EVENTS = ("SELECT user_id AS entity, event_type AS item, ts, value, '' AS unit, event_id "
              "FROM events")
SQL_EVENT_ITEMS = "SELECT DISTINCT event_type AS item, upper(event_type) AS item_code FROM events"
SQL_ORDER_EVENTS = ("SELECT o_custkey AS entity, o_orderpriority AS item, o_orderdate AS ts, "
                    "o_totalprice AS value, '' AS unit, o_orderkey AS event_id FROM orders")
SQL_MIXED_EVENTS = (
    "SELECT o_custkey AS entity, o_orderpriority AS item, "
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS subject, "
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS unit, o_orderdate AS ts, "
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'nan'::DOUBLE "
    "ELSE o_totalprice::DOUBLE END AS value, o_orderkey AS event_id FROM orders")
SQL_PRIORITY_ITEMS = (
    "SELECT DISTINCT o_orderpriority AS item, substring(o_orderpriority, 1, 1) AS item_code FROM orders "
    "UNION ALL SELECT DISTINCT o_orderpriority, 'U' FROM orders WHERE substring(o_orderpriority, 1, 1) = '1'")
SQL_BRAND_EVENTS = ("SELECT o_custkey AS entity, p_brand AS item FROM lineitem "
                    "JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
SQL_BRAND_ITEMS = "SELECT DISTINCT p_brand AS item, substring(p_brand, 7, 100) AS item_code FROM part"
SQL_DIAGNOSES = ("SELECT entity, code, substring(code, 1, 2) AS category FROM ("
                 "SELECT o_custkey AS entity, substring(o_orderpriority, 1, 1) || o_orderstatus "
                 "|| '-' || CAST(o_orderkey % 10 AS VARCHAR) AS code FROM orders)")
