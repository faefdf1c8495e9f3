"""Gaussian process of long series by a tiled Cholesky factorisation.

One task holds a few tiles, never an n x n matrix.  The matrix of a series is
cut into tiles of ``tile`` x ``tile``, rows (series, i, j) of a table.  The
standardised values and the points to predict at are further block rows below
the matrix, so the same elimination turns them into L^-1 y and L^-1 k*.

Panels (block columns) are factorised from left to right, in steps of as many
panels, and in bands of as many block rows, as ``BATCH_BYTES`` holds tiles of.  A
band's block rows meet the step's pivot rows and the values' row in one shuffle;
the band's task subtracts what earlier steps explain (their tiles come sorted by
step, as a stream) and then goes through the step's panels tile by tile: the
diagonal tile is factorised, the tiles below are solved against it and
subtracted from the next panel.  Pivot rows are few, so each band factorises
them by itself rather than wait for them.  All steps but the last are written to
the shared checkpoint folder, so a lost executor costs a step at most; of a step
only the tiles that a later one reads are written, a block row's in one row.

A series of T tiles and steps of P panels shuffles about T^3 / (6 P) tiles and,
once for each of its bands, the pivots' tiles; a series that ends with its first
step shuffles its points only, and its bands are stacked with those of the same
shape, so that many short series go through a panel at once.  The tiles of all
series go through the steps together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from itertools import chain, groupby, islice
from math import isqrt
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapseries.operators.gp import LOG_2PI, STD_FLOOR, unit_kernel
from gapseries.session import cut_lineage, scratch_path

TILE = 1024
# Bytes of tiles in one Arrow batch (one row at least), and of the tiles of a band in one step.
BATCH_BYTES = 64 << 20
# Bytes of the matrices of bands of one shape that go through the panels as one stack.
STACK_BYTES = 1 << 20
# Block rows are points (P), standardised values (Y) or points to predict at (G).
P, Y, G = 0, 1, 2
_DOUBLES = "array<double>"
_TILE = (f"sid long, i int, k int, kind int, tiles int, rows int, cols int, term double, up {_DOUBLES}, "
         f"squares {_DOUBLES}, cells binary")
_NAMES = [f.split()[0] for f in _TILE.split(", ")]
_KINDS = [pa.int64(), *[pa.int32()] * 6, pa.float64(), *[pa.list_(pa.float64())] * 2, pa.binary()]
# What a band's task reads: block rows (m = -1), then the tiles of earlier panels m.
_MET = ["sid", "band", "m", "i", "kind", "own", "tiles", "rows", "alpha", "tau", "cols", "x", "y", "cells"]


@contextmanager
def _small_batches(spark, tile: int):
    """Arrow batches of a bounded number of tiles while the panels run; a row has those of a step."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(1, BATCH_BYTES // (8 * tile * tile * _tile_budget(tile)[0]))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _tile_budget(tile: int) -> tuple[int, int]:
    """Panels of a step and block rows of a band: with the pivots, their tiles fit BATCH_BYTES."""
    n = BATCH_BYTES // (16 * tile * tile)
    panels = max(1, isqrt(n))
    return panels, max(1, n // panels)


def _cells(data: bytes, cols: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, cols)


def _standardised(series: DataFrame, t: str, v: str, alpha: Column, tau: Column) -> DataFrame:
    """Adds sid, n, mean, l2_dev, the values centred and scaled as the model has them, alpha and tau."""
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    dev = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))))
    return (series.withColumn("n", n).withColumn("mean", mean)
            .withColumn("l2_dev", F.when(dev > STD_FLOOR, dev).otherwise(F.lit(1.0)))
            .withColumn("_y", F.transform(v, lambda x: (x - F.col("mean")) / F.col("l2_dev"))).drop(v)
            .withColumn("sid", F.monotonically_increasing_id()).withColumnRenamed(t, "_t")
            .withColumns({"_alpha": alpha, "_tau": tau}))


def _blocks(data: DataFrame, tile: int, grid: Column | None) -> DataFrame:
    """Block rows (sid, i, kind, tiles, rows, x, y, alpha, tau): points, then the values, then the
    points to predict at.  ``tiles``: those of a side of the matrix; ``rows``: all block rows."""
    count = F.ceil(F.col("n") / F.lit(tile)).cast("int")

    def part(array: Column | str, i: Column) -> Column:
        return F.slice(array, i * F.lit(tile) + F.lit(1), F.lit(tile))
    none = F.array().cast("array<double>")
    if grid is not None:
        data = data.withColumn("_grid", grid)
    ahead = F.lit(0) if grid is None else F.ceil(F.size("_grid") / F.lit(tile)).cast("int")
    rows = data.select("*", count.alias("tiles"), (count + 1 + ahead).alias("rows"), F.col("_alpha").alias("alpha"),
                       F.col("_tau").alias("tau"))
    own = ["sid", "tiles", "rows", "alpha", "tau"]
    points = rows.select(*own, "_t", "_y", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"))
    out = points.select(*own, "i", F.lit(P).alias("kind"), part("_t", F.col("i")).alias("x"),
                        part("_y", F.col("i")).alias("y"))
    out = out.unionByName(rows.select(*own, F.col("tiles").alias("i"), F.lit(Y).alias("kind"),
                                      none.alias("x"), none.alias("y")))
    if grid is not None:
        chunks = F.sequence(F.lit(0), F.col("rows") - F.col("tiles") - 2)
        out = out.unionByName(rows.select(*own, "_grid", F.explode(chunks).alias("c")).select(
            *own, (F.col("tiles") + 1 + F.col("c")).alias("i"), F.lit(G).alias("kind"),
            part("_grid", F.col("c")).alias("x"), none.alias("y")))
    return out


def _met(batches) -> Iterator[tuple]:
    """The rows of _MET; the arrays of doubles are views of their batch."""
    for b in batches:
        numbers = [c.to_numpy(zero_copy_only=False).tolist() for c in b.columns[:11]]
        lists = []
        for c in b.columns[11:13]:
            values, ends = c.values.to_numpy(), c.offsets.to_numpy().tolist()
            lists.append([values[at:to] for at, to in zip(ends, ends[1:])])
        yield from zip(*numbers, *lists, b.columns[13].to_pylist())


def _eliminated(k0: int, step: int, sigma2: float, kernel: str, limit: int, stack: int):
    """A task's function: the tiles of its bands in panels k0 .. k0 + step - 1."""
    def found(batches):
        # Bands without tiles of earlier steps wait for others of their shape.
        waiting, held = {}, 0
        for _, rows in groupby(_met(batches), key=itemgetter(0, 1)):
            blocks, tile = [], None
            for tile in rows:
                if tile[2] >= 0:
                    break
                blocks.append(tile)
                tile = None
            band = _Band(blocks, k0, step)
            if tile is not None:
                yield from _eliminate([band], chain([tile], rows), k0, sigma2, kernel)
                continue
            alike = waiting.setdefault(band.shape, [])
            alike.append(band)
            held += band.bytes
            if len(alike) * band.bytes >= stack:
                held -= len(alike) * band.bytes
                yield from _eliminate(waiting.pop(band.shape), (), k0, sigma2, kernel)
            elif held >= limit:
                for bands in waiting.values():
                    yield from _eliminate(bands, (), k0, sigma2, kernel)
                waiting, held = {}, 0
        for bands in waiting.values():
            yield from _eliminate(bands, (), k0, sigma2, kernel)

    def run(batches):
        out, held = [], 0
        for row in found(batches):
            out.append(row)
            held += 64 + sum(len(v) for v in row[-3:] if v is not None)
            if held >= limit or len(out) == 10_000:
                yield _tiles(out)
                out, held = [], 0
        if out:
            yield _tiles(out)
    return run


def _tiles(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=_NAMES)


class _Band:
    """A band's block rows in one step: the pivots of the step's panels, the others of the band and
    the values' row, by number."""

    def __init__(self, blocks: list[tuple], k0: int, step: int):
        self.sid, self.tiles, self.rows, self.alpha, self.tau = (blocks[0][c] for c in (0, 6, 7, 8, 9))
        self.pivots = min(step, self.tiles - k0)
        # (i, kind, own, height) of each block row
        self.blocks = tuple((b[3], b[4], b[5], 1 if b[4] == Y else len(b[11])) for b in blocks)
        self.x = np.concatenate([np.zeros(1) if b[4] == Y else b[11] for b in blocks])
        self.y = np.concatenate([b[12] for b in blocks[:self.pivots]])
        self.shape = self.tiles, self.rows, self.blocks
        self.bytes = 8 * len(self.x) * len(self.y)


def _eliminate(bands: list[_Band], earlier: Iterable[tuple], k0: int, sigma2: float, kernel: str) -> Iterator[tuple]:
    """The tiles of the own block rows of bands of one shape, as one stack.

    ``earlier``: of a band by itself, the tiles of earlier steps, sorted by (m, i): for each step m
    those of the pivots first.
    """
    one = bands[0]
    tiles, pivots, blocks = one.tiles, one.pivots, one.blocks
    ends = np.cumsum([0, *(b[3] for b in blocks)]).tolist()
    at = {b[0]: (ends[r], ends[r + 1]) for r, b in enumerate(blocks)}
    width, values = ends[pivots], at[tiles][0]
    x = np.stack([b.x for b in bands])
    alpha, tau = (np.array(v)[:, None, None] for v in ([b.alpha for b in bands], [b.tau for b in bands]))
    cells = sigma2 * unit_kernel((x[:, :, None] - x[:, None, :width]) ** 2, alpha, tau, kernel)
    n = np.arange(width)
    cells[:, n, n] += sigma2
    cells[:, values] = [b.y for b in bands]
    # What earlier steps explain: L_im L_km' for the panels of each step m.
    for _, met in groupby(earlier, key=itemgetter(2)):
        pivot = np.concatenate([_cells(t[13], t[10]) for t in islice(met, pivots)])
        cells[0, :width] -= pivot @ pivot.T
        for t in met:
            low, up = at[t[3]]
            cells[0, low:up] -= _cells(t[13], t[10]) @ pivot.T
    # The step's own panels.
    for a, b in zip(ends, ends[1:pivots + 1]):
        if a:
            cells[:, a:, a:b] -= cells[:, a:, :a] @ cells[:, a:b, :a].swapaxes(1, 2)
        diagonal = cells[:, a:b, a:b] = np.linalg.cholesky(cells[:, a:b, a:b])
        cells[:, b:, a:b] = np.linalg.solve(diagonal, cells[:, b:, a:b].swapaxes(1, 2)).swapaxes(1, 2)
    last = k0 + pivots - 1
    over = last == tiles - 1  # no later step reads tiles of these series
    logs = np.cumsum(2.0 * np.log(np.diagonal(cells, axis1=1, axis2=2)), axis=1)
    own = [r for r, b in enumerate(blocks) if b[2]]
    diagonals = [r for r in own if r < pivots]
    if diagonals:
        low, up = ends[diagonals[0]], ends[diagonals[-1] + 1]
        terms = (logs[:, up - 1] - (logs[:, low - 1] if low else 0.0)).tolist()
        i = blocks[diagonals[-1]][0]
        for band, term in zip(bands, terms):
            yield band.sid, i, i, P, tiles, one.rows, width, term, None, None, None
    for r in own:
        (i, kind, _, _), low, up = blocks[r], ends[r], ends[r + 1]
        if r < pivots or (over and kind == P):
            continue
        for band, c in zip(bands, cells):
            row = c[low:up]
            term = float((row * row).sum()) if kind == Y else None
            means, squares = (row @ c[values], (row * row).sum(axis=1)) if kind == G else (None, None)
            yield (band.sid, i, last, kind, tiles, one.rows, width, term, means, squares,
                   None if over else row.tobytes())


def _factorise(blocks: DataFrame, sigma2: float, kernel: str, tile: int) -> DataFrame:
    """The factors, a row for each block row and step: (sid, i, k, kind, tiles, rows, cols, term, up,
    squares, cells), k being the step's last panel.

    ``cells`` are the block row's tiles of the step's panels, side by side, if a later step reads
    them.  ``term`` is a values' row's part of y' K^-1 y and, with i = k, the part that the diagonal
    tiles of a band have in the log determinant.  ``up`` and ``squares`` stand with each block row
    to predict: its products with the values' row and its squares, summed over the step's panels.
    The last step is not written: read the result once.
    """
    spark = blocks.sparkSession
    step, band = _tile_budget(tile)
    panels, count = blocks.agg(F.max("tiles"), F.count(F.lit(1))).first()
    # The work is far more than the bytes tell, so the tasks are not left to their sizes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tasks = max(1, min(tasks, count))
    path, done = scratch_path(spark, "gp-tiles"), None
    none = F.array().cast(_DOUBLES)
    for k0 in range(0, panels or 0, step):
        live = (F.col("tiles") > k0) & (F.col("i") >= k0)
        rows = blocks.where(live).withColumns({"m": F.lit(-1), "cols": F.lit(0), "cells": F.lit(None).cast("binary")})
        if done is not None:
            rows = rows.unionByName(done.where(live & F.col("cells").isNotNull()).withColumnRenamed("k", "m").withColumns(
                {"alpha": F.lit(0.0), "tau": F.lit(0.0), "x": none, "y": none}).drop("term", "up", "squares"))
        # Pivots and values go to every band of their series.
        own = F.floor(F.col("i") / F.lit(band)).cast("int")
        bands = F.sequence(F.lit(k0 // band), F.floor((F.col("rows") - 1) / F.lit(band)).cast("int"))
        shared = ((F.col("kind") == P) & (F.col("i") < k0 + step)) | (F.col("kind") == Y)
        met = (rows.withColumn("band", F.explode(F.when(shared, bands).otherwise(F.array(own))))
               .withColumn("own", F.col("band") == own).select(*_MET)
               .repartition(tasks, "sid", "band").sortWithinPartitions("sid", "band", "m", "i"))
        out = met.mapInArrow(_eliminated(k0, step, sigma2, kernel, BATCH_BYTES, STACK_BYTES), _TILE)
        if k0 + step >= panels:
            return out if done is None else done.unionByName(out)
        out.write.mode("append").parquet(path)
        done = spark.read.schema(_TILE).parquet(path)
    return spark.createDataFrame([], _TILE)


def _terms(data: DataFrame, sigma2: float, kernel: str, tile: int) -> DataFrame:
    """(s, q, logdet) of each sid: y' K^-1 y and log det K, one number a tile; the cells are not read."""
    with _small_batches(data.sparkSession, tile):
        tiles = _factorise(_blocks(data, tile, None), sigma2, kernel, tile)
        inner = F.when(F.col("i") == F.col("k"), F.col("term"))
        return cut_lineage(tiles.where(F.col("term").isNotNull()).groupBy(F.col("sid").alias("s")).agg(
            F.sum(F.when(inner.isNull(), F.col("term"))).alias("q"), F.sum(inner).alias("logdet")))


def tiled_grid_terms(series: DataFrame, alphas: Sequence[float], taus: Sequence[float], t: str = "tw",
                     v: str = "v", kernel: str = "rq", tile: int = TILE) -> DataFrame:
    """As :func:`gapseries.operators.gp.gp_grid_terms`, in tiles: each (series, alpha, tau) is a
    factorisation of its own, and all go through the panels together."""
    grid = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(u)).alias("u")) for a in alphas for u in taus])
    each = series.where(F.size(t) > 0).select(t, v, F.explode(grid).alias("_pair"))
    data = cut_lineage(_standardised(each, t, v, F.col("_pair.a"), F.col("_pair.u")).drop("_pair"))
    found = data.join(_terms(data, 1.0, kernel, tile), F.col("sid") == F.col("s"))
    return found.groupBy(F.col("_alpha").alias("alpha"), F.col("_tau").alias("tau")).agg(
        F.sum("q").alias("q"), F.sum("logdet").alias("logdet"),
        F.sum(F.col("n").cast("long")).alias("n_points"), F.count(F.lit(1)).alias("n_series"))


def tiled_log_likelihood(series: DataFrame, keys: Sequence[str], sigma2: float, alpha: float, tau: float,
                         t: str = "tw", v: str = "v", kernel: str = "rq", tile: int = TILE) -> DataFrame:
    """As :func:`gapseries.operators.gp.gp_log_likelihood`, in tiles: keys, n, mean, l2_dev, log_likelihood."""
    data = series.where(F.size(t) > 0).select(*keys, t, v)
    data = cut_lineage(_standardised(data, t, v, F.lit(float(alpha)), F.lit(float(tau))))
    sums = _terms(data, sigma2, kernel, tile)
    ll = -(F.col("q") + F.col("logdet")) / 2.0 - F.col("n") / 2.0 * F.lit(LOG_2PI)
    return (data.join(sums, F.col("sid") == F.col("s"))
            .select(*keys, "n", "mean", "l2_dev", ll.alias("log_likelihood")))


def tiled_resample_arrays(series: DataFrame, keys: Sequence[str], sigma2: float, alpha: float, tau: float,
                          step: float = 0.25, padding_length: float = 20.0, t: str = "tw", v: str = "v",
                          kernel: str = "rq", tile: int = TILE) -> DataFrame:
    """As :func:`gapseries.operators.gp.gp_resample_arrays`, in tiles: keys, t0, mean, variance."""
    if step <= 0:
        raise ValueError("step must be positive")
    pad = padding_length * step / 2.0
    span = F.array_max("_t") + F.lit(pad) - F.col("t0")
    last = F.floor(F.round(span / F.lit(step), 9)).cast("int")
    data = series.where(F.size(t) > 0).select(*keys, t, v)
    data = _standardised(data, t, v, F.lit(float(alpha)), F.lit(float(tau)))
    data = (data.withColumn("t0", F.array_min("_t") - F.lit(pad))
            .withColumn("points", last + 1))
    data = cut_lineage(data)
    grid = F.transform(F.sequence(F.lit(0), F.col("points") - 1), lambda i: F.col("t0") + i * F.lit(step))
    with _small_batches(series.sparkSession, tile):
        tiles = _factorise(_blocks(data, tile, grid), sigma2, kernel, tile)
        # The steps' sums of a block row, in their order; then the block rows of a series.
        parts = tiles.where(F.col("up").isNotNull()).select("sid", "i", "k", "up", "squares").repartition("sid")
        each = parts.groupBy("sid", "i").agg(F.sort_array(F.collect_list(F.struct("k", "up", "squares"))).alias("s"))

        def total(name: str) -> Column:
            zeros = F.transform(F.col(f"s.{name}")[0], lambda x: F.lit(0.0))
            return F.aggregate(f"s.{name}", zeros, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias(name)
        found = cut_lineage(each.select("sid", "i", total("up"), total("squares"))
                            .groupBy(F.col("sid").alias("s")).agg(
            F.sort_array(F.collect_list(F.struct("i", "up", "squares"))).alias("x")))
    out = data.join(found, F.col("sid") == F.col("s"))
    mean = F.transform(F.flatten("x.up"), lambda r: r * F.col("l2_dev") + F.col("mean"))
    variance = F.transform(F.flatten("x.squares"),
                           lambda r: (F.lit(float(sigma2)) - r) * F.col("l2_dev") * F.col("l2_dev"))
    return out.select(*keys, "t0", mean.alias("mean"), variance.alias("variance"))
