"""Benchmark decontamination by greedy string tiling.

Texts are compared as words (case and punctuation aside).  A document that
shares a seed of five words with a benchmark item is tiled against it: the
longest common runs of words not yet marked are marked, again and again, found
by running Karp-Rabin matching from long runs to short ones.  An item counts as
leaked if the tiles cover enough of it, in whatever order its passages stand, or
if one tile alone is a long passage (so long items cannot leak in parts).

The benchmark is broadcast in blocks of bounded size, one after the other;
documents are read whole and never shuffled.

Cases: null, empty and wordless documents hold nothing, such items leak
nowhere; an item shorter than a seed must occur whole; repeated items and
documents are rows each; an empty benchmark or table gives no leak.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapseries.llm.common import materialize, share, shared, text_batches, text_rows, worker_state

SEED_WORDS = 5
COVERAGE = 0.8
# Words of one tile that are a leak whatever share of the item they are.
PASSAGE_WORDS = 50
# Characters of benchmark text broadcast at once.
BLOCK_CHARS = 32_000_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_START = 20  # first length that running Karp-Rabin tries


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _codes(ids: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit code for each word id."""
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words (modulo 2^64)."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    power = np.full(len(codes), _BASE)
    power[0] = 1
    back = np.full(n, _INVERSE)
    back[0] = 1
    sums = np.r_[np.uint64(0), np.cumsum(codes * np.cumprod(power), dtype=np.uint64)]
    return (sums[size:] - sums[:-size]) * np.cumprod(back)


def _free_windows(marked: np.ndarray, size: int) -> np.ndarray:
    taken = np.r_[0, np.cumsum(marked)]
    return taken[size:] == taken[:-size]


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word ids: (start in item, start in doc, length) of each tile."""
    marked_i, marked_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    codes_i, codes_d = _codes(item), _codes(doc)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(_START, len(item)))
    while True:
        matches: list[tuple[int, int, int]] = []
        longest = 0
        h_i, h_d = _window_hashes(codes_i, size), _window_hashes(codes_d, size)
        if len(h_i) and len(h_d):
            free_i = np.flatnonzero(_free_windows(marked_i, size))
            free_d = np.flatnonzero(_free_windows(marked_d, size))
            free_d = free_d[np.isin(h_d[free_d], h_i[free_i])]
            places: dict[int, list[int]] = {}
            for i in free_i.tolist():
                places.setdefault(int(h_i[i]), []).append(i)
            for d in free_d.tolist():
                for i in places.get(int(h_d[d]), ()):
                    # Within a longer run only its start is a match of its own.
                    if i and d and not (marked_i[i - 1] or marked_d[d - 1]) and item[i - 1] == doc[d - 1]:
                        continue
                    k = 0
                    while (i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k]
                           and not (marked_i[i + k] or marked_d[d + k])):
                        k += 1
                    if k >= size:
                        matches.append((k, i, d))
                        longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        matches.sort(key=lambda m: (-m[0], m[1], m[2]))
        again = False
        for k, i, d in matches:
            if marked_i[i:i + k].any() or marked_d[d:d + k].any():
                again = True  # partly taken by a longer tile: what is left is sought anew
                continue
            marked_i[i:i + k] = True
            marked_d[d:d + k] = True
            tiles.append((i, d, k))
        if again:
            continue
        if size <= least:
            return tiles
        size = max(least, size // 2)


class Benchmark:
    """A block of items in the form that documents are probed against."""

    def __init__(self, rows: list[tuple[int, str]], seed_words: int = SEED_WORDS):
        self.vocabulary: dict[str, int] = {}
        self.items, self.names = [], []
        for name, text in rows:
            found = words(text)
            if found:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found]
                self.items.append(np.array(ids, dtype=np.int64))
                self.names.append(name)
        self.least = [min(seed_words, len(x)) for x in self.items]
        # Seeds by length: sorted hashes and, for each, where they stand.
        self.seeds = {}
        for size in sorted(set(self.least)):
            own = [k for k, n in enumerate(self.least) if n == size]
            h = [_window_hashes(_codes(self.items[k]), size) for k in own]
            item = np.repeat(own, [len(x) for x in h])
            at = np.concatenate([np.arange(len(x)) for x in h])
            h = np.concatenate(h)
            order = np.argsort(h, kind="stable")
            self.seeds[size] = h[order], item[order], at[order]

    def _reach(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, words of it under the given seeds) for each item that has one of them.

        Only the places of these seeds are looked at: a range of the sorted ones
        for each hash.
        """
        h, item, at = self.seeds[size]
        first, after = (np.searchsorted(h, hashes, side=side) for side in ("left", "right"))
        many = after - first
        place = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        order = np.lexsort((at[place], item[place]))
        own, start = item[place][order], at[place][order]
        # A seed adds the words up to the next one of its item, its own at most.
        last = np.r_[own[1:] != own[:-1], True]
        adds = np.where(last, size, np.minimum(np.r_[start[1:] - start[:-1], 0], size))
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        return own[begin], np.add.reduceat(adds, begin)

    def leaks(self, text: str | None, coverage: float = COVERAGE, passage_words: int = PASSAGE_WORDS):
        """(item position, covered words, item words, tiles) for each item the text covers enough."""
        found = words(text)
        if not found or not self.items:
            return
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in found), dtype=np.int64, count=len(found))
        known = ids >= 0
        if not known.any():
            return
        for size, (h, _, _) in self.seeds.items():
            if len(ids) < size:
                continue
            whole = np.flatnonzero(_free_windows(~known, size))
            if not len(whole):
                continue
            doc_h = _window_hashes(_codes(ids), size)[whole]
            place = np.minimum(np.searchsorted(h, doc_h), len(h) - 1)
            hit = h[place] == doc_h
            if not hit.any():
                continue
            near = np.zeros(len(ids), bool)
            for k in range(size):
                near[whole[hit] + k] = True
            # Words off all seeds are no part of a tile: one gap stands for each stretch.
            border = np.flatnonzero(near)
            cut = np.insert(ids[border], np.flatnonzero(np.diff(border) > 1) + 1, -1)
            where = np.insert(border, np.flatnonzero(np.diff(border) > 1) + 1, -1)
            # The words that matching seeds reach bound what tiles can cover.
            for k, reach in zip(*(x.tolist() for x in self._reach(size, np.unique(doc_h[hit])))):
                words_of = self.items[k]
                if reach < min(coverage * len(words_of), passage_words):
                    continue
                tiles = tile(words_of, cut, size)
                covered = sum(t[2] for t in tiles)
                longest = max((t[2] for t in tiles), default=0)
                if covered >= coverage * len(words_of) or longest >= passage_words:
                    yield k, covered, len(words_of), [(i, int(where[d]), n) for i, d, n in sorted(tiles)]


def _held_block(held, name: str) -> Benchmark:
    """The broadcast block, unpacked once for each Python worker (which keeps one block)."""
    kept = worker_state("benchmark", dict)
    if name not in kept:
        kept.clear()
        kept[name] = shared(held)
    return kept[name]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
           seed_words: int = SEED_WORDS, block_chars: int = BLOCK_CHARS):
    """The benchmark as a series of :class:`Benchmark` of about ``block_chars`` characters.

    Items are dealt to blocks by hash, so blocks are even; an item is never cut.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(
        F.col("text").isNotNull())
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block_chars))
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).orderBy("id", "text").collect()
        yield Benchmark([(r.id, r.text) for r in got], seed_words)


_LEAKS = "doc_id long, item_id long, covered long, item_words long, coverage double, " \
         "tiles array<struct<item_start:int,doc_start:int,length:int>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", seed_words: int = SEED_WORDS,
               coverage: float = COVERAGE, passage_words: int = PASSAGE_WORDS,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item it covers: doc_id, item_id, covered, item_words, coverage, tiles."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int64()),
                        ("item_words", pa.int64()), ("coverage", pa.float64()),
                        ("tiles", pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()),
                                                      ("length", pa.int32())])))])
    parts = []
    for block in blocks(benchmark, item_col, item_text_col, seed_words, block_chars):
        held = share(docs.sparkSession, block)

        def run(batches, held=held, name=uuid.uuid4().hex):
            bench = _held_block(held, name)
            for batch in batches:
                out = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for k, covered, n, tiles in bench.leaks(t.as_py(), coverage, passage_words):
                        out.append({"doc_id": i, "item_id": bench.names[k], "covered": covered,
                                    "item_words": n, "coverage": covered / n,
                                    "tiles": [dict(zip(("item_start", "doc_start", "length"), x)) for x in tiles]})
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        parts.append(rows.mapInArrow(run, _LEAKS))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", seed_words: int = SEED_WORDS, coverage: float = COVERAGE,
               passage_words: int = PASSAGE_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that cover no benchmark item, with all their columns."""
    columns, kept = list(docs.columns), docs
    for block in blocks(benchmark, item_col, item_text_col, seed_words, block_chars):
        held = share(docs.sparkSession, block)
        if kept is not docs:
            kept = materialize(kept, "clean")

        def run(batches, held=held, name=uuid.uuid4().hex):
            bench = _held_block(held, name)
            for batch, texts in text_batches(batches, at):
                clean = [next(bench.leaks(t.as_py(), coverage, passage_words), None) is None
                         for t in texts.cast(pa.string())]
                part = pa.RecordBatch.from_arrays(batch.columns[:len(columns)], names=columns)
                yield part.filter(pa.array(clean, pa.bool_()))
        rows, at = text_rows(kept, columns, text_col)
        kept = rows.mapInArrow(run, docs.schema)
    return kept
