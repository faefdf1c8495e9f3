"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into three segments.  Two fingerprints that differ in at
most four bits differ in at most one bit of some segment, so they agree there
once one bit is left out (a wildcard).  Each fingerprint is indexed under every
segment with every bit left out, an equality key; fingerprints that share a key
are compared in full.

A segment alone is a key of some 20 bits, shared by ever more fingerprints as a
table grows.  So each key also holds a piece of the bits outside the segment: if
the segment differs in one bit, the others differ in at most three, and of four
pieces of them one is equal.  If it does not differ, they differ in at most
four, and of five pieces one is equal; for that a single wildcard is enough.
Keys have 28 to 32 bits and lose no link.

Copies are collapsed first: the index holds distinct fingerprints.  A large key
gives the edges of a spanning forest instead of all its pairs, found in blocks
of bounded size.

Cases: null, empty and blank texts have fingerprint zero and link like any
other; rows repeated stay rows; a null id is ignored by the smallest id, and a
class of null ids only has a null class id; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapseries.llm.common import free_name, materialize, text_batches, text_rows
from gapseries.llm.components import connected_components

BITS = 64
# Segments as (lowest bit, width).  Fixed by the method: three for four bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_DISTANCE = 4
# Fingerprints of one key compared at once; larger keys are cut into blocks.
BLOCK = 2048
# Pieces of the bits outside a segment: it differs in one bit, or not at all.
DIFFERING, EQUAL = 4, 5
_PIECE_BITS = 11
_VALUE_BITS = 22 + _PIECE_BITS
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    last = len(words) - shingle
    if last <= 0:
        starts, stops = [0], [len(joined)]
    else:
        starts, stops = [0, *ends[:last]], [e - 1 for e in ends[shingle - 1:]]
    digest, n = xxhash.xxh64_digest, len(starts)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        raw = b"".join([digest(joined[i:j], seed) for i, j in
                        zip(starts[at:at + _CHUNK], stops[at:at + _CHUNK])])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, *, text_col: str = "text", name: str = "fingerprint",
                      keep: list[str] | None = None, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Add ``name``, the fingerprint's 64 bits as a signed long; carry ``keep`` (default: all)."""
    keep = list(docs.columns) if keep is None else list(keep)
    rows, at = text_rows(docs, keep, text_col)

    def run(batches):
        for batch, texts in text_batches(batches, at):
            prints = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts),
                                 dtype=np.uint64, count=len(texts))
            columns = [*batch.columns[:len(keep)], pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, name])

    schema = docs.select(*keep).schema.add(name, "long")
    return rows.mapInArrow(run, schema)


def _pieces(width: int, parts: int) -> list[tuple[int, int]]:
    """The bits outside a segment of ``width``, cut into (lowest bit, width) pieces."""
    cuts = [i * (BITS - width) // parts for i in range(parts + 1)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:])]


def _tag(hole, parts, piece):
    """The number of a key's kind: its wildcard bit, how the rest is cut, and which piece."""
    return (hole * (DIFFERING + EQUAL)) + (piece if parts == DIFFERING else DIFFERING + piece)


def _around(x: np.ndarray, low: int, width: int) -> np.ndarray:
    """The bits outside a segment: those behind it, then those before it."""
    turn = (low + width) % BITS
    return (x >> np.uint64(turn)) | (x << np.uint64((BITS - turn) % BITS))


def _cut(x: np.ndarray, low: int, width: int) -> np.ndarray:
    return (x >> np.uint64(low)) & np.uint64((1 << width) - 1)


def variant_keys(x: np.ndarray):
    """All (segment, wildcard, piece) keys of fingerprints: an array (keys, fingerprints) for each segment."""
    for low, width in SEGMENTS:
        rest, own = _around(x, low, width), _cut(x, low, width)
        keys = []
        for hole in range(low, low + width):
            value = (own & ~np.uint64(1 << (hole - low))) << np.uint64(_PIECE_BITS)
            for parts in (DIFFERING, EQUAL) if hole == low else (DIFFERING,):
                keys += [np.uint64(_tag(hole, parts, i) << _VALUE_BITS) | value | _cut(rest, at, wide)
                         for i, (at, wide) in enumerate(_pieces(width, parts))]
        yield np.stack(keys).view(np.int64)


def _index(batches):
    """Rows (key, fp), a segment of some fingerprints at a time."""
    few = 2000
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(values), few):
            x = values[at:at + few]
            for keys in variant_keys(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.tile(x.view(np.int64), len(keys)))], names=["key", "fp"])


def _first_segment(diff: np.ndarray):
    """For each difference of linked fingerprints: segment, wildcard bit, and whether it differs there.

    The first segment that differs in one bit; if there is none, the first that
    does not differ, with its lowest bit as the wildcard.
    """
    segment, hole = np.full(len(diff), -1), np.full(len(diff), -1, dtype=np.int64)
    differs = np.zeros(len(diff), dtype=bool)
    for want in (1, 0):
        for i, (low, width) in enumerate(SEGMENTS):
            part = _cut(diff, low, width)
            take = (segment < 0) & (np.bitwise_count(part) == want)
            bit = np.where(part > 0, np.log2(np.maximum(part, 1).astype(np.float64)), 0).astype(np.int64)
            segment[take], hole[take], differs[take] = i, (low + bit)[take], want == 1
    return segment, hole, differs


def _first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The wildcard bit of the first key that two linked fingerprints share."""
    return _first_segment(a ^ b)[1]


def _first_tag(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The kind (see :func:`_tag`) of the one key at which a link is given."""
    diff = a ^ b
    segment, hole, differs = _first_segment(diff)
    tag = np.full(len(diff), -1, dtype=np.int64)
    for i, (low, width) in enumerate(SEGMENTS):
        rest = _around(diff, low, width)
        for parts, mine in ((DIFFERING, differs), (EQUAL, ~differs)):
            for j, (at, wide) in enumerate(_pieces(width, parts)):
                same = _cut(rest, at, wide) == 0
                tag = np.where((segment == i) & mine & same & (tag < 0), _tag(hole, parts, j), tag)
    return tag


def _forest(values: np.ndarray, other: np.ndarray | None = None, distance: int = MAX_DISTANCE):
    """Edges that connect all fingerprints within ``distance``.

    Breadth first: each value taken up is compared with those not yet reached,
    which only shrink, so a dense group costs little more than its size.  With
    ``other``, edges between the two sets are sought as well as inside them.
    """
    pool = values if other is None else np.concatenate([values, other])
    rest, a, b = pool.copy(), [], []
    frontier: list[np.uint64] = []
    while len(rest):
        if not frontier:
            frontier, rest = [rest[0]], rest[1:]
            continue
        at = frontier.pop()
        near = np.bitwise_count(rest ^ at) <= distance
        if near.any():
            found = rest[near]
            a.extend([at] * len(found))
            b.append(found)
            frontier.extend(found)
            rest = rest[~near]
    return (np.array(a, dtype=np.uint64), np.concatenate(b)) if b else (pool[:0], pool[:0])


def _small_keys(keys: np.ndarray, values: np.ndarray):
    """All links among rows of equal keys (sorted), by shifting the rows past each other.

    A pair that shares several keys is given at the first of them only.
    """
    a, b = [], []
    lag = 1
    live = np.arange(len(keys))
    while len(live):
        live = live[live + lag < len(keys)]
        live = live[keys[live] == keys[live + lag]]
        x, y = values[live], values[live + lag]
        near = np.bitwise_count(x ^ y) <= MAX_DISTANCE
        x, y, tag = x[near], y[near], keys[live][near] >> _VALUE_BITS
        once = _first_tag(x, y) == tag
        a.append(x[once])
        b.append(y[once])
        lag += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])


_EDGE = "a long, b long, key long, block int"


def _edge_batch(a: np.ndarray, b: np.ndarray):
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(n, pa.int64()),
         pa.nulls(n, pa.int32())], names=["a", "b", "key", "block"])


def _scan_keys(batches):
    """Edges of a task's keys; rows of keys over BLOCK are handed on with a block number.

    The rows come sorted by key.  At most one batch and one block are held.
    """
    few = 64  # up to so many rows of a key are compared by shifting
    held_k, held_v = np.empty(0, np.int64), np.empty(0, np.uint64)
    large_key, block = None, 0

    def hand_on(key, values, number):
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), pa.nulls(n, pa.int64()),
             pa.array(np.full(n, key, np.int64)), pa.array(np.full(n, number, np.int32))],
            names=["a", "b", "key", "block"])

    def finish(k, v):
        """Edges of whole keys."""
        if not len(k):
            return
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        count = np.diff(np.r_[first, len(k)])
        small = np.repeat(count <= few, count)
        a, b = _small_keys(k[small], v[small])
        if len(a):
            yield _edge_batch(a, b)
        for i, n in zip(first[count > few], count[count > few]):
            a, b = _forest(v[i:i + n])
            if len(a):
                yield _edge_batch(a, b)

    for batch in batches:
        k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
        v = np.concatenate([held_v, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        while len(k):
            if k[0] == large_key:  # more of a key that is handed on
                n = int(np.searchsorted(k, large_key, side="right"))
                for at in range(0, n, BLOCK):
                    block += 1
                    yield hand_on(large_key, v[at:min(n, at + BLOCK)], block)
                k, v = k[n:], v[n:]
                continue
            tail = int(np.searchsorted(k, k[-1], side="left"))  # the last key may go on
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            over = first[np.diff(np.r_[first, len(k)]) > BLOCK]
            if len(over):
                at = int(over[0])
                yield from finish(k[:at], v[:at])
                large_key, block = k[at], -1
                k, v = k[at:], v[at:]
                continue
            yield from finish(k[:tail], v[:tail])
            k, v = k[tail:], v[tail:]
            break
        held_k, held_v = k, v
    yield from finish(held_k, held_v)


def _pair_blocks(batches):
    """Forest edges of pairs of blocks: rows (values of both blocks)."""
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1)):
            v = np.array(x.as_py(), dtype=np.int64).view(np.uint64)
            w = np.array(y.as_py(), dtype=np.int64).view(np.uint64) if y.is_valid else None
            a, b = _forest(v, w)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                                 names=["a", "b"])


def links(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges (a, b) of distinct fingerprints that connect all within MAX_DISTANCE bits."""
    # A few bytes of fingerprints become many keys: a fixed number of tasks makes them.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = prints.select(fp).repartition(tasks, fp).mapInArrow(_index, "key long, fp long")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    found = materialize(dealt.mapInArrow(_scan_keys, _EDGE), "simhash-links")
    direct = found.where(F.col("key").isNull()).select("a", "b")
    # Large keys: each pair of a key's blocks is a task's row of at most 2 * BLOCK values.
    blocks = materialize(found.where(F.col("key").isNotNull()).groupBy("key", "block")
                         .agg(F.collect_list("a").alias("v")), "simhash-blocks")
    left = blocks.select("key", F.col("block").alias("i"), F.col("v").alias("x"))
    right = blocks.select(F.col("key").alias("rk"), F.col("block").alias("j"), F.col("v").alias("y"))
    pairs = left.join(right, (F.col("key") == F.col("rk")) & (F.col("i") <= F.col("j")))
    pairs = pairs.select("key", "i", "j", "x", F.when(F.col("i") < F.col("j"), F.col("y")).alias("y"))
    across = pairs.repartition("key", "i", "j").select("x", "y").mapInArrow(_pair_blocks, "a long, b long")
    return direct.unionByName(across).where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    keep: list[str] | None = None, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Each row with ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable over links of fingerprints
    within four bits.  ``keep`` names the input columns to carry (default: all);
    the added columns get a leading underscore where the input has the name.
    """
    rows, roots, names = _linked(docs, id_col, text_col, keep, shingle, seed)
    return _labelled(rows, roots, names)


def _linked(docs, id_col, text_col, keep, shingle, seed):
    keep = list(docs.columns) if keep is None else list(keep)
    names = {"keep": keep, "fingerprint": free_name("fingerprint", keep),
             "component_id": free_name("component_id", keep)}
    fp, key = (free_name(n, [*docs.columns, "fp", "root"]) for n in ("_fp", "_id"))
    names |= {"fp": fp, "id": key}
    source = docs.withColumn(key, F.col(id_col))
    rows = materialize(with_fingerprints(source, text_col=text_col, name=fp, keep=[*keep, key],
                                         shingle=shingle, seed=seed), "simhash-rows")
    groups = materialize(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("least")),
                         "simhash-prints")
    parts = connected_components(links(groups))
    labelled = groups.join(parts, groups["fp"] == parts["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = materialize(labelled, "simhash-roots")
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    roots = labelled.select("fp", "root").join(least, "root")
    return rows, materialize(roots, "simhash-components"), names


def _labelled(rows, roots, names):
    return (rows.join(roots, rows[names["fp"]] == roots["fp"])
            .select(*[rows[c] for c in names["keep"]],
                    F.lpad(F.lower(F.hex(rows[names["fp"]])), 16, "0").alias(names["fingerprint"]),
                    roots["component"].alias(names["component_id"])))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 4, seed: int = 42) -> DataFrame:
    """One row of each class: the smallest id; of rows that repeat it, one."""
    uid = free_name("_uid", docs.columns)
    tagged = docs.withColumn(uid, F.monotonically_increasing_id())
    rows, roots, names = _linked(tagged, id_col, text_col, None, shingle, seed)
    first = F.min(F.struct(F.col(names["id"]).isNull(), F.col(names["id"]), F.col(uid))).alias("_first")
    joined = rows.select(names["fp"], names["id"], uid).join(roots, F.col(names["fp"]) == roots["fp"])
    kept = joined.groupBy("root").agg(first).select(F.col(f"_first.{uid}").alias(uid))
    return rows.join(kept, uid, "left_semi").select(*docs.columns)
