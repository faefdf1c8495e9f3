"""Exact top-k by inner product: columnar branch-and-bound over dimension blocks.

Candidates lie in vertical layout (a row of memory for each dimension).  Scores
are accumulated block of dimensions by block; after each block a candidate's
score is bounded by what it has and, by Cauchy-Schwarz, the mass its and the
query's remaining dimensions have.  Candidates that cannot reach any query's
k-th best score are compacted away.

The stated query set meets all rows in blocks of bounded size: each block of
queries is broadcast, every task keeps the best of its rows, and the winners
are merged by query.

Cases: rows whose id or vector is null, or whose vector holds a null or
non-finite component, take no part; a query's own row is every row with its
id; a query id that repeats is one query (its least vector); repeated candidate
rows are candidates each; only vectors of a query's length are compared;
an empty table, or no other row, gives no rows.  Components are scaled and
floored to integers; scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapseries.llm.common import materialize
from gapseries.session import scratch_path

# Queries broadcast at once, queries scored together, candidates held at once.
QUERY_BLOCK = 4096
GROUP = 128
ROWS = 8192
DIM_BLOCK = 16


def quantize(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): usable vectors as arrays of floor(scale * x)."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    finite = F.forall(F.col(vector_col), lambda c: F.coalesce(
        F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")))


def _dtype(q: np.ndarray, c: np.ndarray):
    """Doubles where they are exact, else 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return np.float64 if most < 2.0 ** 52 else np.int64


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Of (query row, id, score) the k best of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[keep], scores[keep]


def _scores_over(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray,
                 floor: np.ndarray, k: int):
    """(query row, id, score) of the candidates that may be among the k best.

    ``q`` is (queries, dims), ``c`` (dims, candidates) in vertical layout,
    ``floor`` a lower bound on each query's k-th best score.
    """
    kind = _dtype(q, c)
    if kind is np.int64:  # the comparisons below round to doubles
        floor = floor - np.abs(floor) * 2.0 ** -50
    order = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    q, c = q[:, order].astype(kind), c[order].astype(kind)
    score = np.zeros((len(q), c.shape[1]), dtype=kind)
    alive = np.arange(c.shape[1])
    q_left, c_left = ((x.astype(np.float64) ** 2) for x in (q, c))
    dims = len(order)
    for at in range(0, dims, DIM_BLOCK):
        to = min(dims, at + DIM_BLOCK)
        score = score + q[:, at:to] @ c[at:to]
        if to < dims:
            room = np.sqrt(np.outer(q_left[:, to:].sum(axis=1), c_left[to:].sum(axis=0)))
            may = (score + room * (1 + 1e-9) + 1e-6 >= floor[:, None]).any(axis=0)
            if not may.all():
                score, c, c_left, alive = score[:, may], c[:, may], c_left[:, may], alive[may]
        if not len(alive):
            break
    ids = c_ids[alive]
    hit = score >= floor[:, None]
    hit &= q_ids[:, None] != ids[None, :]
    rows, cols = np.nonzero(hit)
    return _best(rows, ids[cols], score[rows, cols].astype(np.int64), k)


def _kth(rows, scores, n: int, k: int, floor: np.ndarray) -> np.ndarray:
    """Raise ``floor`` to the k-th best score of the rows that have k."""
    count = np.bincount(rows, minlength=n)
    last = np.cumsum(count) - 1
    return np.where(count >= k, np.maximum(floor, scores[np.maximum(last, 0)] if len(scores) else floor), floor)


def _blocks(batches, dims: int):
    """Candidates with ``dims`` components as (ids, vertical matrix), ROWS at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            size = pa.compute.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
            mine = np.flatnonzero(size == dims)
            if len(mine):
                v = part.column(1).take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False)
                yield (part.column(0).to_numpy(zero_copy_only=False)[mine],
                       np.ascontiguousarray(v.reshape(len(mine), dims).T))


def _search(queries, k: int):
    """A task's function: the best candidates for each broadcast query."""
    def run(batches):
        held = list(queries.value)  # (ids, matrix, floor) for each vector length
        found = [[[], [], []] for _ in held]
        floors = [f.astype(np.float64) for _, _, f in held]
        for batch in batches:
            for n, (q_ids, q, _) in enumerate(held):
                for c_ids, c in _blocks([batch], q.shape[1]):
                    for g in range(0, len(q_ids), GROUP):
                        s = slice(g, g + GROUP)
                        rows, ids, scores = _scores_over(q[s], q_ids[s], c, c_ids, floors[n][s], k)
                        floors[n][s] = _kth(rows, scores, len(q_ids[s]), k, floors[n][s])
                        for part, x in zip(found[n], (rows + g, ids, scores)):
                            part.append(x)
                if sum(map(len, found[n][0])) > 4 * k * len(q_ids):
                    best = _best(*(np.concatenate(x) for x in found[n]), k)
                    found[n] = [[x] for x in best]
        for (q_ids, _, _), parts in zip(held, found):
            if parts[0]:
                rows, ids, scores = _best(*(np.concatenate(x) for x in parts), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(ids), pa.array(scores)],
                                                 names=["query_id", "vec_id", "score"])
    return run


def _by_length(rows, k: int):
    """Collected queries as (ids, matrix, floor) by vector length.

    The queries are candidates too: their scores against each other give a
    first lower bound on the k-th best.
    """
    lengths: dict[int, list] = {}
    for r in rows:
        lengths.setdefault(len(r.v), []).append(r)
    out = []
    for dims, own in sorted(lengths.items()):
        ids = np.array([r.vec_id for r in own], dtype=np.int64)
        q = np.array([r.v for r in own], dtype=np.int64).reshape(len(own), dims)
        floor = np.full(len(ids), -np.inf)
        for g in range(0, len(ids), GROUP):
            s = slice(g, g + GROUP)
            rows_, _, scores = _scores_over(q[s], ids[s], np.ascontiguousarray(q.T), ids, floor[s], k)
            floor[s] = _kth(rows_, scores, len(ids[s]), k, floor[s])
        out.append((ids, q, floor))
    return out


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The k best candidates of every query: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    usable = materialize(quantize(vectors, id_col, vector_col, scale), "topk-vectors")
    queries = vectors.where(is_query)
    queries = (quantize(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v")))
    queries = materialize(queries, "topk-queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    path = scratch_path(spark, "topk-found")
    for b in range(blocks):
        held = spark.sparkContext.broadcast(_by_length(queries.where(block == b).collect(), k))
        (usable.mapInArrow(_search(held, k), "query_id long, vec_id long, score long")
         .write.mode("append").parquet(path))
        held.unpersist()
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (spark.read.schema("query_id long, vec_id long, score long").parquet(path)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
