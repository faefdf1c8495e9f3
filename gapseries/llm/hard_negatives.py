"""Hard negatives: rows of another label that score nearly as high as a positive.

Candidates lie in blocks along a Hilbert curve over all dimensions, so a block
holds vectors that are near each other.  A zone map keeps each block's minimum
and maximum in every dimension; interval arithmetic gives bounds on the score
of any of its rows with an anchor.  An anchor reads the blocks whose bounds
meet its windows: first the positives' window (down to the worst of the best
positives known so far), then a window for each positive.

Anchors are taken along the curve in batches of bounded bytes.  For a batch the
zone maps are scanned alone and choose runs of blocks; Spark reads these runs
from Parquet (the block number is pushed down to the row groups), and a task
bounds each block it holds again for each anchor before it scores any row.
Each task keeps the best rows of its windows; they are merged by window.

Cases: rows whose id, label or vector is null, or whose vector holds a null or
non-finite component, take no part; an anchor id that repeats is one anchor
(its least label and vector), and rows with the anchor's id are neither its
positives nor its negatives; other repeated rows are rows each; only vectors of
an anchor's length are compared; a positive with a negative score has an empty
window; an empty table gives no rows.  Components are scaled and floored to
integers; scores must fit a long.  Columns other than the three are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapseries.llm.common import materialize
from gapseries.session import scratch_path

# Rows of a block, components of a batch of anchors, anchors scored together.
BLOCK = 1024
BATCH = 1 << 21
GROUP = 256
# Stretches of the curve whose choice the driver is told, and runs of blocks in
# one pushed filter; nearest runs are joined beyond that.
STRETCHES = 4096
RUNS = 64
# Bits of a Hilbert key over all dimensions (at least one for each).
KEY_BITS = 256
ROW_GROUP = 4 << 20


# ---------------------------------------------------------- Hilbert order ---

def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``cells`` (rows, dims), as byte strings.

    ``cells`` holds integers of ``bits`` bits.  Reflections and rotations are
    undone from the highest bit down, then the axes are Gray-coded and their
    bits interleaved, all dimensions' highest bits first.
    """
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(dims):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(turned, low, swap).astype(np.uint32)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[dims - 1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flip
    planes = np.stack([(x >> np.uint32(level)) & 1 for level in range(bits - 1, -1, -1)])  # bits, dims, rows
    return np.packbits(planes.reshape(bits * dims, -1).T.astype(np.uint8), axis=1)


def _with_keys(mean: float, spread: float):
    """A task's function: adds the Hilbert key to (vec_id, label, anchor, v)."""
    def run(batches):
        for batch in batches:
            size = pa.compute.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            keys = np.empty(batch.num_rows, dtype=object)
            for dims in np.unique(size):
                at = np.flatnonzero(size == dims)
                if not dims:
                    keys[at] = b""
                    continue
                v = batch.column(3).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                bits = int(min(8, max(1, KEY_BITS // dims)))
                half = 1 << (bits - 1)
                cell = np.floor((v.reshape(len(at), dims) - mean) * (half / (3 * spread))) + half
                made = hilbert_keys(np.clip(cell, 0, 2 * half - 1).astype(np.int64), bits)
                for i, row in zip(at, made):
                    keys[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())],
                                             names=[*batch.schema.names, "key"])
    return run


_ROW = "vec_id long, label long, anchor boolean, v array<long>"
_PLACED = "block long, " + _ROW


def _numbered(batches):
    """Rows in curve order get a block number: the task's number, then BLOCK rows each."""
    from pyspark import TaskContext
    first, seen, dims = TaskContext.get().partitionId() << 32, 0, None
    for batch in batches:
        size = pa.compute.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
        blocks = np.empty(batch.num_rows, dtype=np.int64)
        # A block holds vectors of one length.
        cut = np.flatnonzero(np.r_[True, size[1:] != size[:-1]])
        for i, j in zip(cut, np.r_[cut[1:], len(size)]):
            if size[i] != dims:
                first, seen, dims = first + -(-seen // BLOCK), 0, size[i]
            blocks[i:j] = first + (seen + np.arange(j - i)) // BLOCK
            seen += j - i
        yield pa.RecordBatch.from_arrays([pa.array(blocks), *batch.columns[:4]],
                                         names=["block", *batch.schema.names[:4]])


def _held_blocks(batches):
    """(block, ids, labels, anchor flags, matrix) for each run of a block's rows in each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for i, j in zip(cut.tolist(), np.r_[cut[1:], len(block)].tolist()):
            part = batch.slice(i, j - i)
            v = part.column(4).flatten().to_numpy(zero_copy_only=False)
            yield (int(block[i]), part.column(1).to_numpy(zero_copy_only=False),
                   part.column(2).to_numpy(zero_copy_only=False),
                   part.column(3).to_numpy(zero_copy_only=False), v.reshape(j - i, -1))


# ----------------------------------------------------------------- scores ---

def _kind(*matrices):
    """Doubles where products are exact in them, else 64-bit integers."""
    most = [float(np.abs(m).max(initial=0)) for m in matrices]
    return np.float64 if most[0] * max(most[1:]) * max(1, matrices[0].shape[-1]) < 2.0 ** 52 else np.int64


def zone_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Least and most score of each anchor with any vector in each box, (anchors, boxes)."""
    kind = _kind(anchors, low, high)
    up, down = np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
    low, high = low.astype(kind).T, high.astype(kind).T
    return up @ low + down @ high, up @ high + down @ low


def _best(window, score, vec_id, *more, k: int):
    """Of parallel arrays the k best of each window: highest score, then smallest id."""
    order = np.lexsort((vec_id, -score, window))
    w = window[order]
    keep = order[np.arange(len(w)) - np.searchsorted(w, w, side="left") < k]
    return [x[keep] for x in (window, score, vec_id, *more)]


class _Windows:
    """Windows [low, high] of scores for anchors, same label or another, and their best rows."""

    def __init__(self, ids, labels, vectors, owner, low, high, same: bool, k: int):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.owner, self.low, self.high = owner, low.copy(), high
        self.same, self.k = same, k
        self.found = [[], [], []]
        self.held = 0
        self._reach()

    def _reach(self):
        """For each anchor the lowest and highest score that any of its windows takes."""
        top = np.iinfo(np.int64)
        self.least = np.full(len(self.ids), top.max)
        self.most = np.full(len(self.ids), top.min)
        open_ = self.low <= self.high
        np.minimum.at(self.least, self.owner[open_], self.low[open_])
        np.maximum.at(self.most, self.owner[open_], self.high[open_])

    def wants(self, low, high, label_low, label_high) -> np.ndarray:
        """Which anchors must read which boxes, (anchors, boxes)."""
        least, most = zone_bounds(self.vectors, low, high)
        want = (most >= self.least[:, None]) & (least <= self.most[:, None])
        mine = self.labels[:, None]
        if self.same:
            return want & (label_low <= mine) & (mine <= label_high)
        return want & ~((label_low == mine) & (label_high == mine))

    def take(self, ids, labels, vectors):
        """Score the rows of one block for the anchors whose windows its box meets."""
        low, high = vectors.min(axis=0)[None], vectors.max(axis=0)[None]
        want = np.flatnonzero(self.wants(low, high, labels.min(), labels.max())[:, 0])
        kind = _kind(self.vectors, vectors)
        rows = vectors.astype(kind).T
        for at in range(0, len(want), GROUP):
            own = want[at:at + GROUP]
            score = self.vectors[own].astype(kind) @ rows
            hit = (score >= self.least[own, None]) & (score <= self.most[own, None])
            hit &= (labels == self.labels[own, None]) == self.same
            hit &= ids != self.ids[own, None]
            a, r = np.nonzero(hit)
            if len(a):
                self._keep(own[a], ids[r], score[a, r].astype(np.int64))

    def _keep(self, anchor, ids, score):
        first = np.searchsorted(self.owner, anchor, side="left")
        many = np.searchsorted(self.owner, anchor, side="right") - first
        pair = np.repeat(np.arange(len(anchor)), many)
        window = first[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        inside = (score[pair] >= self.low[window]) & (score[pair] <= self.high[window])
        pair, window = pair[inside], window[inside]
        for part, x in zip(self.found, (window, score[pair], ids[pair])):
            part.append(x)
        self.held += len(window)
        if self.held > 4 * self.k * len(self.owner) + 100_000:
            self._compact()

    def _compact(self):
        """Keep the best, and raise each full window's floor to its worst."""
        window, score, ids = _best(*(np.concatenate(x) for x in self.found), k=self.k)
        self.found, self.held = [[window], [score], [ids]], len(window)
        full = np.bincount(window, minlength=len(self.owner)) >= self.k
        last = np.searchsorted(window, np.arange(len(self.owner)), side="right") - 1
        self.low[full] = np.maximum(self.low[full], score[last[full]])
        self._reach()

    def best(self):
        if not self.found[0]:
            return None
        self._compact()
        return [x[0] for x in self.found]


_FOUND = "anchor_id long, place int, positive_id long, positive_score long, vec_id long, score long"


def _scan(held):
    """A task's function: the best rows for the windows of a broadcast batch of anchors."""
    def run(batches):
        batch = held.value
        searches = {dims: _Windows(*part) for dims, part in batch["windows"].items()}
        for _, ids, labels, _, vectors in _held_blocks(batches):
            if vectors.shape[1] in searches:
                searches[vectors.shape[1]].take(ids, labels, vectors)
        for dims, search in searches.items():
            best = search.best()
            if best:
                window, score, ids = best
                yield pa.RecordBatch.from_arrays(
                    [pa.array(search.ids[search.owner[window]]),
                     *(pa.array(x[window]) for x in batch["names"][dims]), pa.array(ids), pa.array(score)],
                    names=[f.split()[0] for f in _FOUND.split(", ")])
    return run


def _zones(batches):
    """Zone maps: (block, label_low, label_high, low, high) of the rows of each block held."""
    out = []
    for block, _, labels, _, v in _held_blocks(batches):
        out.append((block, int(labels.min()), int(labels.max()), v.min(axis=0).tolist(), v.max(axis=0).tolist()))
        if len(out) == 256:
            yield _zone_batch(out)
            out = []
    if out:
        yield _zone_batch(out)


_ZONE = "block long, label_low long, label_high long, low array<long>, high array<long>"


def _zone_batch(rows):
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=[f.split()[0] for f in _ZONE.split(", ")])


def _floors(k: int):
    """A task's function: anchors with the k-th best positive of their own block as a floor."""
    def run(batches):
        for block, ids, labels, is_anchor, v in _held_blocks(batches):
            at = np.flatnonzero(is_anchor)
            kind = _kind(v, v)
            rows = v.astype(kind).T
            floors = np.full(len(at), np.iinfo(np.int64).min)
            for n, i in enumerate(at):
                score = np.sort((v[i].astype(kind) @ rows)[(labels == labels[i]) & (ids != ids[i])])
                if len(score) >= k:
                    floors[n] = int(score[-k])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), block)), pa.array(ids[at]), pa.array(labels[at]),
                     pa.array([x.tolist() for x in v[at]], pa.list_(pa.int64())), pa.array(floors)],
                    names=["block", "vec_id", "label", "v", "floor"])
    return run


def _chosen(held):
    """A task's function over zone maps: the blocks that a window of the batch meets."""
    def run(batches):
        searches = {dims: _Windows(*part) for dims, part in held.value["windows"].items()}
        for batch in batches:
            block, lo_label, hi_label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            size = pa.compute.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            for dims, search in searches.items():
                at = np.flatnonzero(size == dims)
                if len(at):
                    low, high = (batch.column(c).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                                 .reshape(len(at), dims) for c in (3, 4))
                    want = np.zeros(len(at), dtype=bool)
                    for g in range(0, len(at), GROUP):
                        s = slice(g, g + GROUP)
                        want[s] = search.wants(low[s], high[s], lo_label[at[s]], hi_label[at[s]]).any(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(block[at[want]])], names=["block"])
    return run


# ------------------------------------------------------------ Spark level ---

class Blocks:
    """Candidates in Hilbert-ordered Parquet blocks, with their zone maps."""

    def __init__(self, rows: DataFrame):
        """``rows``: vec_id, label, anchor, v (integers); written in curve order."""
        self.spark = rows.sparkSession
        moments = rows.select(F.explode("v").alias("x")).agg(
            F.avg("x").alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s")).first()
        keyed = rows.mapInArrow(_with_keys(moments.m or 0.0, moments.s or 1.0), _ROW + ", key binary")
        # Rows with equal keys are dealt by a hash, so that one place on the curve is split too.
        order = [F.size("v"), F.col("key"), F.xxhash64("vec_id", "label"), F.col("vec_id")]
        placed = (keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                  .mapInArrow(_numbered, _PLACED))
        self.path = scratch_path(self.spark, "negatives-blocks")
        placed.write.option("parquet.block.size", str(ROW_GROUP)).parquet(self.path)
        self.rows = self.spark.read.schema(_PLACED).parquet(self.path)
        self.zones = materialize(self.rows.mapInArrow(_zones, _ZONE), "negatives-zones")
        self.stretch = 1 + self.zones.count() // STRETCHES

    def runs(self, held) -> Column | None:
        """A filter for the blocks that the windows meet; None if no block does.

        The driver receives the first and last block met of each stretch of the
        curve, at most STRETCHES and one for each file; nearest runs are joined
        beyond RUNS.
        """
        number = F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
        met = (self.zones.mapInArrow(_chosen(held), "block long")
               .groupBy(F.shiftright("block", 32).alias("file"), F.floor(number / self.stretch).alias("part"))
               .agg(F.min("block").alias("a"), F.max("block").alias("b")).collect())
        if not met:
            return None
        runs = sorted((r.a, r.b) for r in met)
        gaps = sorted(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1], reverse=True)[:RUNS - 1]
        cut = [0, *sorted(gaps), len(runs)]
        ends = [(runs[i][0], runs[j - 1][1]) for i, j in zip(cut, cut[1:])]
        return reduce(Column.__or__, [F.col("block").between(a, b) for a, b in ends])

    def search(self, windows: dict, names: dict, path: str) -> bool:
        """Append the best rows of the windows, as found by each task, to ``path``."""
        held = self.spark.sparkContext.broadcast({"windows": windows, "names": names})
        chosen = self.runs(held)
        if chosen is not None:
            self.rows.where(chosen).mapInArrow(_scan(held), _FOUND).write.mode("append").parquet(path)
        held.unpersist()
        return chosen is not None


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each window over all tasks, with their rank."""
    w = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _by_length(anchors) -> dict:
    """Collected anchors as {dims: (ids, labels, matrix, floors)}."""
    lengths: dict[int, list] = {}
    for r in sorted(anchors, key=lambda r: r.vec_id):
        lengths.setdefault(len(r.v), []).append(r)
    return {dims: (*(np.array([r[c] for r in own], np.int64) for c in ("vec_id", "label")),
                   np.array([r.v for r in own], np.int64).reshape(len(own), dims),
                   np.array([r.floor for r in own], np.int64)) for dims, own in lengths.items()}


def _mine_batch(blocks: Blocks, anchors: DataFrame, path: str, positives: int, negatives: int,
                least_percent: int, most_percent: int) -> None:
    """Append the negatives that each task finds for a batch of anchors."""
    held = _by_length(anchors.collect())
    windows, names = {}, {}
    for dims, (ids, labels, matrix, floors) in held.items():
        everything = np.full(len(ids), np.iinfo(np.int64).max)
        windows[dims] = (ids, labels, matrix, np.arange(len(ids)), floors, everything, True, positives)
        names[dims] = (np.zeros(len(ids), np.int32), ids, everything)
    near = scratch_path(blocks.spark, "negatives-positives")
    if not blocks.search(windows, names, near):
        return
    best = _ranked(blocks.spark.read.schema(_FOUND).parquet(near), positives).select(
        "anchor_id", "rank", "vec_id", "score").collect()
    by_anchor: dict[int, list] = {}
    for r in sorted(best, key=lambda r: (r.anchor_id, r.rank)):
        by_anchor.setdefault(r.anchor_id, []).append(r)
    windows, names = {}, {}
    for dims, (ids, labels, matrix, _) in held.items():
        rows = [(n, r) for n, i in enumerate(ids.tolist()) for r in by_anchor.get(i, ())]
        if rows:
            owner = np.array([n for n, _ in rows], np.int64)
            place, positive_id, score = (np.array([r[c] for _, r in rows], np.int64)
                                         for c in ("rank", "vec_id", "score"))
            # Percentages of 100 q + r, so that no product overflows.
            q, r = score // 100, score % 100
            low, high = least_percent * q - (-least_percent * r // 100), most_percent * q + most_percent * r // 100
            windows[dims] = (ids, labels, matrix, owner, low, high, False, negatives)
            names[dims] = (place.astype(np.int32), positive_id, score)
    if windows:
        blocks.search(windows, names, path)


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, *, label: Column | None = None,
                        positives: int = 5, negatives: int = 5, least_percent: int = 80,
                        most_percent: int = 100, id_col: str = "vec_id", vector_col: str = "embedding",
                        label_col: str = "label", scale: int = 256) -> DataFrame:
    """For each anchor and each of its best ``positives``, the best ``negatives``.

    A negative has another label and a score from ``least_percent`` to
    ``most_percent`` per cent of the positive's.  Columns: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.  ``label``
    replaces the label column (an expression of the input's columns).
    """
    spark = vectors.sparkSession
    wanted = F.col(label_col) if label is None else label
    finite = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    rows = (vectors.where(F.col(id_col).isNotNull() & wanted.isNotNull() & F.col(vector_col).isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("vec_id"), wanted.cast("long").alias("label"),
                    F.coalesce(is_anchor, F.lit(False)).alias("anchor"), x.alias("v")))
    blocks = Blocks(materialize(rows, "negatives-rows"))
    # One anchor for each id, in the order of the curve.
    home = blocks.rows.mapInArrow(_floors(positives), "block long, vec_id long, label long, v array<long>, floor long")
    anchors = materialize(home.groupBy("vec_id").agg(F.min(F.struct("label", "v", "floor", "block")).alias("a"))
                          .select("vec_id", "a.*"), "negatives-anchors")
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    batches = -(-size.n // max(1, BATCH // max(1, size.dims or 1)))
    cuts = sorted(set(anchors.approxQuantile("block", [i / batches for i in range(1, batches)], 0.1 / batches))) \
        if batches > 1 else []
    path = scratch_path(spark, "negatives-found")
    spark.createDataFrame([], _FOUND).write.parquet(path)
    for after, upto in zip([None, *cuts], [*cuts, None]):
        own = anchors if after is None else anchors.where(F.col("block") > after)
        own = own if upto is None else own.where(F.col("block") <= upto)
        _mine_batch(blocks, own, path, positives, negatives, least_percent, most_percent)
    return _ranked(spark.read.schema(_FOUND).parquet(path), negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
