"""Raw, warped and resampled series side by side (long form, for display)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapseries.functions.columns import uncertainty_band

_KEY = "_key"


def series_overlay(series: DataFrame, resampled: DataFrame, keys: Sequence[str],
                   step: float = 0.25) -> DataFrame:
    """Raw (relative time), warped, GP mean and the mean -/+ one standard
    deviation band: keys, kind, t, y.

    ``series`` (keys, t, tw, v) and ``resampled`` (keys, t0, mean, variance)
    have one row per series; they are joined once, and series missing from
    either side are skipped (:func:`overlay_missing` names them).
    """
    keys = list(keys)
    s = series.select(F.struct(*keys).alias(_KEY), "t", "tw", "v")
    r = resampled.select(F.struct(*keys).alias(_KEY), "t0", "mean", "variance")

    def points(p):
        return F.array(F.struct(F.lit("raw").alias("kind"), p["t"].alias("t"), p["v"].alias("y")),
                       F.struct(F.lit("warped").alias("kind"), p["tw"].alias("t"), p["v"].alias("y")))

    def grid(p, i):
        t = F.col("t0") + i * F.lit(step)
        lower, upper = uncertainty_band(p["mean"], p["variance"])
        return F.array(*[F.struct(F.lit(kind).alias("kind"), t.alias("t"), y.alias("y")) for kind, y in
                         (("mean", p["mean"]), ("lower", lower), ("upper", upper))])

    rows = F.flatten(F.concat(F.transform(F.arrays_zip("t", "tw", "v"), points),
                              F.transform(F.arrays_zip("mean", "variance"), grid)))
    return s.join(r, _KEY).select(f"{_KEY}.*", F.inline(rows))


def overlay_missing(series: DataFrame, resampled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series that :func:`series_overlay` skips: keys and ``missing_from``,
    the side that lacks them ('series' or 'resampled').

    One full outer join of the distinct keys; a null in a key column is a value
    like any other.
    """
    sides = [df.select(F.struct(*keys).alias(name)).distinct()
             for df, name in ((series, "_s"), (resampled, "_r"))]
    met = sides[0].join(sides[1], F.col("_s") == F.col("_r"), "full_outer")
    alone = met.where(F.col("_s").isNull() | F.col("_r").isNull())
    side = F.when(F.col("_s").isNull(), F.lit("series")).otherwise(F.lit("resampled"))
    return alone.select(F.coalesce("_s", "_r").alias(_KEY), side.alias("missing_from")).select(
        f"{_KEY}.*", "missing_from")
