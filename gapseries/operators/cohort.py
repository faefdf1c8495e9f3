"""Cohort operators: minimum-length pairs, item support, exclusive cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapseries.functions.columns import indicator
from gapseries.operators._util import as_list


def min_length_pairs(events: DataFrame, entity: str, item: str, n: int = 3) -> DataFrame:
    """(entity, item) pairs with at least ``n`` rows.

    Rows are counted whatever their value or time (null entities form a pair of
    their own, which later inner joins never match).  Partial aggregation runs
    map-side, so a hot pair costs one counter per task, not a hot shuffle.
    """
    return (events.groupBy(entity, item).agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") >= n).select(entity, item))


def item_support(pairs: DataFrame, item: str, n: int = 30) -> DataFrame:
    """Items with at least ``n`` qualifying pairs: (item, count)."""
    return (pairs.groupBy(item).agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") >= n))


def supported_pairs(pairs: DataFrame, support: DataFrame, entity: str, item: str) -> DataFrame:
    """Pairs whose item is supported; null entities dropped (the support side
    is unique per item, so an inner join equals this semi join)."""
    return (pairs.where(F.col(entity).isNotNull())
            .join(support.select(item), item, "left_semi")
            .select(entity, item))


def exclusive_cohort(diagnoses: DataFrame, entity: str, category: str,
                     code1: str, code2: str) -> DataFrame:
    """Entities with rows of exactly one of two categories.

    Returns (entity, num_code1, num_code2).  Rows of other categories cannot
    change the outcome, so they are filtered before the shuffle.
    """
    if code1 == code2:
        raise ValueError("exclusive_cohort needs two different codes")
    relevant = diagnoses.where(F.col(category).isin(code1, code2))
    counts = relevant.groupBy(entity).agg(
        F.sum(indicator(category, code1)).cast("bigint").alias("num_code1"),
        F.sum(indicator(category, code2)).cast("bigint").alias("num_code2"))
    return counts.where((F.col("num_code1") > 0) != (F.col("num_code2") > 0))


def cohort_labels(cohort: DataFrame, entity: str, code1: str, code2: str,
                  out: str = "ICD9_CATEGORY") -> DataFrame:
    """(entity, label): ``code1`` when it occurs, else ``code2``."""
    label = (F.when(F.col("num_code1") > 0, F.lit(code1))
             .when(F.col("num_code2") > 0, F.lit(code2)))
    return cohort.select(entity, label.alias(out))


def min_length_events(events: DataFrame, entity: str, item: str, n: int = 3) -> DataFrame:
    """Events of pairs with at least ``n`` rows (a semi join on the pairs).

    The semi join keeps the aggregate map-side combined and lets AQE split a
    skewed pair across tasks.
    """
    pairs = min_length_pairs(events, entity, item, n).where(F.col(entity).isNotNull())
    return events.join(pairs, [entity, item], "left_semi")


def item_dimension_for(dim: DataFrame, item: str, item_code: str,
                       codes: str | Sequence[str]) -> DataFrame:
    """Items of the dimension whose code is one of ``codes``."""
    return dim.where(F.col(item_code).isin(as_list(codes))).select(item, item_code)


def select_item_events(events: DataFrame, dim: DataFrame, item: str, item_code: str,
                       codes: str | Sequence[str]) -> DataFrame:
    """Events of the items carrying the given item code(s), code attached.

    The filtered dimension is joined, so an item listed under several of the
    codes gives its events once for each.  AQE broadcasts the chosen items when
    they turn out small, and a runtime filter then prunes the event scan.
    """
    chosen = item_dimension_for(dim, item, item_code, codes)
    return events.join(chosen, item, "inner").select(*events.columns, item_code)
