"""Q2: cohort of series with exactly one of two categories, time-warped,
optionally class-balanced, split train/test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapseries.operators.cohort import cohort_labels, exclusive_cohort, select_item_events
from gapseries.operators.sampling import balance_classes, split_column
from gapseries.operators.series import BLOCK_DAYS, T_REL, T_WARP, time_warp, to_points
from gapseries.roles import Roles
from gapseries.session import cut_lineage


def build_cohort(events: DataFrame, items: DataFrame, diagnoses: DataFrame, *,
                 roles: Roles, item_codes: str | Sequence[str], code1: str, code2: str,
                 item_code: str = "item_code", diag_category: str = "category",
                 min_length: int = 3, warp_a: float = 3.0, warp_b: float = 0.0,
                 balance: str | None = None, train_ratio: float = 0.7,
                 seed: int = 74565, null_values: str = "drop",
                 length_key: str = "pair", block_days: float = BLOCK_DAYS) -> DataFrame:
    """Long-form cohort series.

    Output: series key (entity, item, [subject], [unit], class label), tie,
    ``t_rel`` (days since the series' first point), ``t_warped``, value,
    ``split`` ('train' / 'test' by key hash).

    Plan: the chosen items are joined to the event scan; the cohort is one
    small aggregate joined on entity (AQE turns either into a broadcast when
    small).  The length test counts every row of each (entity, item) pair (null
    values and times included); ``length_key="series"`` counts by the full
    series key (unit and class included) instead.  Series that pass reach the
    warp as a filter of its block summaries, so points are shuffled once, on
    (series, time block), and no series is confined to one task.

    ``balance`` chooses the series of each class from the counts, before
    anything is warped; only then are the counts written first, since the
    quotas read them more than once.
    """
    if code1 == code2:
        raise ValueError("build_cohort needs two different codes")
    if length_key not in ("pair", "series"):
        raise ValueError("length_key must be 'pair' or 'series'")
    keys = roles.series_key
    ev = select_item_events(events, items, roles.item, item_code, item_codes).drop(item_code)
    cohort = exclusive_cohort(diagnoses, roles.entity, diag_category, code1, code2)
    labels = cohort_labels(cohort, roles.entity, code1, code2, out=roles.category)
    ev = ev.join(labels, roles.entity, "inner")
    if roles.unit:
        ev = ev.withColumn(roles.unit, F.coalesce(F.col(roles.unit).cast("string"), F.lit("")))
    pts = to_points(ev, roles, null_values=null_values)

    count_key = keys if length_key == "series" else [roles.entity, roles.item]
    kept = (ev.groupBy(*count_key).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_length).select(*count_key))
    if balance:
        # A series is one with points, of a pair that is long enough.
        series = pts.select(*keys).distinct()
        wanted = kept.select(F.struct(*count_key).alias("_want"))
        series = cut_lineage(series.join(wanted, F.struct(*count_key) == F.col("_want"), "left_semi"))
        kept = balance_classes(series, keys, roles.category, classes=[code1, code2],
                               method=balance, seed=seed)
    warped = time_warp(pts, keys, tie=roles.tie, a=warp_a, b=warp_b, block_days=block_days,
                       series_filter=kept)
    out_cols = keys + ([roles.tie] if roles.tie else []) + [T_REL, T_WARP, roles.value]
    return warped.select(*out_cols).withColumn(
        "split", split_column(roles.split_key, train_ratio, seed))
