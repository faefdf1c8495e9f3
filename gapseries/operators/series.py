"""Series operators in long form (one row per point) on Spark windows.

Long form is the default representation: every step is a window or an
aggregate over the series key, so a series is never materialised as one object
unless an operator needs it whole (the Gaussian process, which assembles arrays
with :func:`build_series`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapseries.functions.columns import epoch_days
from gapseries.operators.ordering import running_total
from gapseries.roles import Roles
from gapseries.session import cut_lineage

T_DAYS = "t_days"
T_REL = "t_rel"
T_WARP = "t_warped"


def to_points(events: DataFrame, roles: Roles, *, null_values: str = "drop",
              keep: Sequence[str] = ()) -> DataFrame:
    """Normalise an event table to points: key columns, ``t_days``, value, tie.

    Rows without a time are dropped.  ``null_values="drop"`` drops rows without
    a value, ``"zero"`` reads them as 0.0 (what unboxing a null double does); a
    NaN value counts as none.  A null unit becomes the empty string.
    """
    df = events.where(F.col(roles.time).isNotNull())
    value = F.col(roles.value)
    if dict(df.dtypes)[roles.value] in ("double", "float"):
        value = F.nanvl(value, F.lit(None).cast("double"))
    if null_values == "drop":
        df = df.where(value.isNotNull())
    elif null_values == "zero":
        df = df.withColumn(roles.value, F.coalesce(value, F.lit(0.0)))
    else:
        raise ValueError("null_values must be 'drop' or 'zero'")
    df = df.withColumn(T_DAYS, epoch_days(df, roles.time))
    if roles.unit:
        df = df.withColumn(roles.unit, F.coalesce(F.col(roles.unit).cast("string"), F.lit("")))
    cols = list(dict.fromkeys(roles.series_key + [T_DAYS, roles.value]
                              + ([roles.tie] if roles.tie else []) + list(keep)))
    return df.select(*[c for c in cols if c in df.columns])


def _order(t: str, tie: str | None) -> list[Column]:
    return [F.col(t).asc()] + ([F.col(tie).asc()] if tie else [])


# Days of a series that are sorted together; a series is spread over as many
# tasks as it has such blocks with points.  A block of more points than
# BLOCK_POINTS (a burst) is cut at quantiles of its times into PARTS parts.
BLOCK_DAYS = 1.0
BLOCK_POINTS = 200_000
PARTS = 128
# Rows of cut points that are broadcast; more are joined by a shuffle.
BROADCAST_CUTS = 5_000
# Own points of a chunk of a nested series.
CHUNK_POINTS = 10_000
_KEY, _BLK, _CUTS = "_key", "_blk", "_cuts"


def _bursts(df: DataFrame, t: str, block_points: int) -> DataFrame | None:
    """Cut points (key, block, cuts) of the blocks with more than ``block_points`` points.

    One aggregate counts the points of every block (combined on the map side).
    Only the blocks over the bound are read again, for the quantiles of their
    times; these are mergeable summaries, so no task sees a whole block.
    """
    dense = (df.groupBy(_KEY, _BLK).agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > block_points).select(_KEY, _BLK))
    n = dense.count()
    if not n:
        return None
    dense = cut_lineage(dense)
    inside = df.join(F.broadcast(dense) if n <= BROADCAST_CUTS else dense, [_KEY, _BLK], "left_semi")
    cuts = F.percentile_approx(t, [i / PARTS for i in range(1, PARTS)], 100 * PARTS)
    cut = cut_lineage(inside.groupBy(_KEY, _BLK).agg(F.array_distinct(cuts).alias(_CUTS)))
    return F.broadcast(cut) if n <= BROADCAST_CUTS else cut


def _blocked(points: DataFrame, keys: Sequence[str], t: str, tie: str | None, block_days: float,
             block_points: int | None):
    """Points clustered on (series, time block), and the window over a block.

    The key columns are held in one struct: structs compare null fields as
    equal, so a series whose key holds a null is a series like any other, and
    shuffle, windows and joins all agree on one column.  Blocks are ``block_days``
    long; a burst is cut into parts of about equal counts (points of one instant
    stay together), so a series is spread however its points lie in time.
    """
    if block_days <= 0:
        raise ValueError("block_days must be positive")
    df = (points.withColumn(_KEY, F.struct(*keys))
          .withColumn(_BLK, F.floor(F.col(t) / F.lit(block_days)).cast("long")))
    cut = None if block_points is None else _bursts(df, t, block_points)
    part = F.lit(0)
    if cut is not None:
        df = df.join(cut, [_KEY, _BLK], "left")
        part = F.coalesce(F.size(F.filter(_CUTS, lambda c: c <= F.col(t))), F.lit(0))
        part = F.when(F.col(_CUTS).isNull(), F.lit(0)).otherwise(part)
    df = df.withColumn(_BLK, F.col(_BLK) * F.lit(PARTS) + part)
    if cut is not None:
        df = df.drop(_CUTS)
    df = df.repartition(_KEY, _BLK)
    return df, Window.partitionBy(_KEY, _BLK).orderBy(*_order(t, tie))


def relative_time(points: DataFrame, keys: Sequence[str], t: str = T_DAYS,
                  out: str = T_REL) -> DataFrame:
    """``t - min(t)`` over each series: a map-side-combined minimum, joined back."""
    first = points.groupBy(F.struct(*keys).alias(_KEY)).agg(F.min(t).alias("_t0"))
    return (points.withColumn(_KEY, F.struct(*keys)).join(first, _KEY)
            .withColumn(out, F.col(t) - F.col("_t0")).drop(_KEY, "_t0"))


def time_deltas(points: DataFrame, keys: Sequence[str], t: str = T_REL,
                tie: str | None = None, out: str = "dt",
                block_days: float = BLOCK_DAYS, block_points: int | None = BLOCK_POINTS) -> DataFrame:
    """Successive differences inside each series (null on the first point).

    Within a time block by a window, into a block from the last time of the
    block before it.  ``block_points`` as in :func:`time_warp`.
    """
    df, w = _blocked(points, keys, t, tie, block_days, block_points)
    df = df.withColumn("_prev", F.lag(t).over(w))
    ends = df.groupBy(_KEY, _BLK).agg(F.max(t).alias("_hi"))
    before = ends.select(_KEY, _BLK, F.lag("_hi").over(
        Window.partitionBy(_KEY).orderBy(_BLK)).alias("_into"))
    return (df.join(before, [_KEY, _BLK])
            .withColumn(out, F.col(t) - F.coalesce("_prev", "_into"))
            .drop(_KEY, _BLK, "_prev", "_into"))


def time_warp(points: DataFrame, keys: Sequence[str], t: str = T_DAYS,
              tie: str | None = None, a: float = 3.0, b: float = 0.0,
              block_days: float = BLOCK_DAYS, series_filter: DataFrame | None = None,
              rel: str = T_REL, out: str = T_WARP, block_points: int | None = BLOCK_POINTS) -> DataFrame:
    """Relative time and polynomial time warp as a two-level prefix sum.

    Each gap d between successive points becomes ``d ** (1/a) + b`` and the
    warped time is their running sum from 0, so output length equals input
    length and the first point sits at 0.

    1. Points are clustered on (series key, time block of ``block_days``) and
       warped locally inside each block (lag, running sum).
    2. Per-block summaries (first and last time, sum of local increments) are
       aggregated without a new shuffle; a window over the blocks of each
       series (a few rows per series) gives the series start, the gap into
       each block and each block's starting offset.
    3. One join on (key, block) -- the point side is already clustered on it --
       adds the offsets back.

    A series holding any share of the rows is spread over as many tasks as it
    has blocks.  Blocks of more than ``block_points`` points are cut further at
    quantiles of their times; finding them counts the points of all blocks first
    (None leaves that out).  ``series_filter`` (columns a subset of ``keys``) keeps only
    matching series; it is applied to the summaries, so the point side never
    reshuffles for it.  Nulls in key columns are values like any other.
    """
    if a == 0:
        raise ValueError("warp exponent a must be non-zero")
    keys = list(keys)
    inv = F.lit(1.0 / a)
    df, w = _blocked(points, keys, t, tie, block_days, block_points)
    df = df.withColumn("_gap", F.col(t) - F.lag(t).over(w))
    df = df.withColumn("_inc", F.when(F.col("_gap").isNull(), F.lit(0.0))
                       .otherwise(F.pow(F.col("_gap"), inv) + F.lit(b)))
    df = df.withColumn("_loc", F.sum("_inc").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_gap")

    # The point count reads every column, so this branch keeps the same
    # columns as the point side below the exchange and AQE reuses the shuffle.
    summ = df.groupBy(_KEY, _BLK).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"),
                                      F.sum("_inc").alias("_s"),
                                      F.count(F.struct(*df.columns)).alias("_n"))
    df = df.drop("_inc")
    if series_filter is not None:
        fields = list(series_filter.columns)
        kept = series_filter.distinct().select(F.struct(*fields).alias("_want"))
        summ = summ.join(kept, F.struct(*[F.col(f"{_KEY}.{f}") for f in fields]) == F.col("_want"),
                         "left_semi")
    ws = Window.partitionBy(_KEY).orderBy(_BLK)
    summ = summ.withColumn("_t0", F.first("_lo").over(ws))
    prev = F.lag("_hi").over(ws)
    summ = summ.withColumn("_fi", F.when(prev.isNull(), F.lit(0.0)).otherwise(
        F.pow((F.col("_lo") - F.col("_t0")) - (prev - F.col("_t0")), inv) + F.lit(b)))
    before = F.sum(F.col("_fi") + F.col("_s")).over(
        ws.rowsBetween(Window.unboundedPreceding, -1))
    summ = summ.withColumn("_start", F.coalesce(before, F.lit(0.0)) + F.col("_fi"))
    joined = df.join(summ.select(_KEY, _BLK, "_t0", "_start"), [_KEY, _BLK], "inner")
    return (joined.withColumn(rel, F.col(t) - F.col("_t0"))
            .withColumn(out, F.col("_start") + F.col("_loc"))
            .drop(_KEY, _BLK, "_t0", "_start", "_loc"))


def build_series(points: DataFrame, keys: Sequence[str], value: str,
                 t: str = T_REL, tw: str = T_WARP, tie: str | None = None,
                 max_points: int | None = None, partitions: int | None = None) -> DataFrame:
    """Nested form: one row per series with sorted parallel arrays t, tw, v.

    Sorting is by (t, tie), the tie in its own type, so ties never depend on
    arrival order.  When ``max_points`` is given (there is no default), a longer
    series raises an error instead of being silently cut.  ``partitions`` deals
    the series out to as many tasks with the one shuffle.
    """
    tie_col = F.col(tie) if tie else F.lit(0)
    pts = F.struct(F.col(t).alias("t"), tie_col.alias("k"), F.col(tw).alias("tw"),
                   F.col(value).cast("double").alias("v"))
    df = points.select(F.struct(*keys).alias(_KEY), pts.alias("_pt"))
    if partitions:
        df = df.repartition(partitions, _KEY)
    agg = df.groupBy(_KEY).agg(F.sort_array(F.collect_list("_pt")).alias("_p"))
    if max_points is not None:
        short = F.when(F.size("_p") <= max_points, F.col("_p")).otherwise(
            F.raise_error(F.lit(f"series longer than max_points={max_points}")))
        agg = agg.withColumn("_p", short)
    return agg.select(*[F.col(f"{_KEY}.{k}").alias(k) for k in keys],
                      F.col("_p.t").alias("t"), F.col("_p.tw").alias("tw"),
                      F.col("_p.v").alias("v"))


def flatten_series(series: DataFrame, keys: Sequence[str], value: str = "v",
                   t: str = T_REL, tw: str = T_WARP) -> DataFrame:
    """Nested series back to long rows (position-wise zip of the arrays)."""
    z = F.arrays_zip(F.col("t").alias("t"), F.col("tw").alias("tw"), F.col("v").alias("v"))
    return (series.select(*keys, F.inline(z))
            .select(*keys, F.col("t").alias(t), F.col("tw").alias(tw), F.col("v").alias(value)))


def series_positions(points: DataFrame, keys: Sequence[str], t: str = T_REL, tie: str | None = None,
                     out: str = "pos") -> DataFrame:
    """Each point's place in its series, from 0, in the order of (t, tie).

    Points are range-partitioned on (key, t, tie), so the ranges of a hot series
    are as many as its share of the rows; a point's place is its place in the
    whole order less that of the series' first point.  Points that tie in all of
    these take any order among each other.
    """
    order = [F.col(k).asc_nulls_first() for k in keys] + _order(t, tie)
    placed = cut_lineage(running_total(points, order, F.lit(1), out).withColumn(_KEY, F.struct(*keys)))
    first = placed.groupBy(_KEY).agg(F.min(out).alias("_first"))
    return placed.join(first, _KEY).withColumn(out, F.col(out) - F.col("_first")).drop(_KEY, "_first")


def chunk_series(points: DataFrame, keys: Sequence[str], columns: Sequence[str], size: int = CHUNK_POINTS,
                 halo: int = 0, pos: str = "pos") -> DataFrame:
    """Nested form in rows of bounded size: keys, ``chunk``, ``at`` and an array for each column.

    Chunk c holds the points at places c * ``size`` onwards: ``size`` of its own
    and then the first ``halo`` of what follows, so that whatever spans up to
    halo + 1 points is whole in the chunk where it starts.  ``at`` is the place of
    its first point.  ``pos`` is the place from 0 without gaps: that of
    :func:`series_positions`, or the index of a grid.  A hot series is spread
    over as many tasks as it has chunks; nulls in key columns are values like
    any other, nulls in ``columns`` stay in their places.
    """
    if size < 1 or halo < 0:
        raise ValueError("size must be >= 1 and halo >= 0")
    at = F.col(pos).cast("long")
    since = F.greatest(F.floor((at - F.lit(halo)) / F.lit(size)), F.lit(0))
    held = F.sequence(since.cast("long"), F.floor(at / F.lit(size)).cast("long"))
    entry = F.struct(at.alias("p"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = points.select(F.struct(*keys).alias(_KEY), entry.alias("_pt"), F.explode(held).alias("chunk"))
    chunks = rows.groupBy(_KEY, "chunk").agg(F.sort_array(F.collect_list("_pt")).alias("_p"))
    return chunks.select(*[F.col(f"{_KEY}.{k}").alias(k) for k in keys], "chunk",
                         (F.col("chunk") * F.lit(size)).alias("at"),
                         *[F.col(f"_p.c{i}").alias(c) for i, c in enumerate(columns)])


def flatten_chunks(chunks: DataFrame, keys: Sequence[str], columns: Sequence[str], size: int = CHUNK_POINTS,
                   pos: str = "pos") -> DataFrame:
    """Chunks back to long rows, each point once (the halo belongs to the next chunk)."""
    own = F.arrays_zip(*[F.slice(c, 1, size).alias(c) for c in columns])
    return (chunks.select(*keys, "at", F.posexplode(own).alias("_i", "_pt"))
            .select(*keys, (F.col("at") + F.col("_i")).alias(pos), *[F.col(f"_pt.{c}").alias(c) for c in columns]))


def series_stats(points: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Per series: n, first/last time, span, mean and L2 deviation of values.

    ``l2_dev`` is the root of the sum of squared deviations (not divided by
    n), the scale the Gaussian process standardises by.
    """
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(t).alias("t_min"), F.max(t).alias("t_max"),
        (F.max(t) - F.min(t)).alias("span"),
        F.avg(value).alias("mean"),
        (F.stddev_pop(value) * F.sqrt(F.count(F.lit(1)))).alias("l2_dev"))


def grid_size(t_min: Column, t_max: Column, step: float, pad: float) -> Column:
    """Number of grid points from ``t_min - pad`` to ``t_max + pad`` inclusive.

    The quotient is rounded to 9 decimals before the floor, so a span that is
    an exact multiple of the step in decimal keeps its last point.
    """
    q = (t_max - t_min + F.lit(2.0 * pad)) / F.lit(step)
    return (F.floor(F.round(q, 9)) + 1).cast("int")


def regular_grid(points: DataFrame, keys: Sequence[str], tw: str = T_WARP,
                 step: float = 0.25, padding_length: float = 20.0,
                 out: str = T_WARP) -> DataFrame:
    """Per series, the regular resampling grid ``min-pad .. max+pad by step``.

    ``pad = padding_length * step / 2`` (2.5 days with the defaults).  Grid
    values are ``start + i * step`` (no accumulated drift).  One row per grid
    point: keys, ``i``, ``out``.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    pad = padding_length * step / 2.0
    ext = points.groupBy(*keys).agg(F.min(tw).alias("_lo"), F.max(tw).alias("_hi"))
    ext = ext.withColumn("_n", grid_size(F.col("_lo"), F.col("_hi"), step, pad))
    return (ext.select(*keys, F.col("_lo"), F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1)))
            .select(*keys, F.col("col").alias("i"),
                    (F.col("_lo") - F.lit(pad) + F.col("col") * F.lit(step)).alias(out)))

