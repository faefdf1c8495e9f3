"""Substring dedup: Rabin-Karp hashes of every fixed-length word window.

Each window of ``window`` consecutive words of one document has a rolling hash
of 88 bits: two polynomials modulo 2^64 over 128-bit word hashes, one kept in
full and the 24 highest bits of the other.  A window is removed if its word sequence also
starts in a document of smaller id; windows are judged on the input, and the
removed windows of a document merge into maximal intervals of words.

Documents are dealt into chunks by a hash of id and text.  A chunk sends, for
each range of hash values, its distinct windows with the smallest id that has
each: sorted, difference-coded and packed, so a window that repeats a million
times in a chunk is one entry of it.  Ranges are counted across chunks, and one
bit for each entry goes back: whether a smaller id has it elsewhere.  The chunk
then marks its windows.  Both passes read one shuffle of the texts.

Two different windows are taken for equal with a chance of 2^-88 for each pair
(about 2^-83 if one permutes the other's words): for 10^10 windows, about 30 GB
of Parquet, a chance below 10^-6 that any pair is.

Cases: null, empty and blank texts have no words and no spans; a text of fewer
words than a window loses nothing; rows that share an id never remove each
other's words, whatever their texts; a null id counts as the largest long;
repeated rows stay rows; columns that the operator adds get a leading
underscore where the input has the name; an empty table gives no rows.  Ids are
integers.  Rows alike in id and text meet in one chunk.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapseries.llm.common import free_name

WINDOW = 13
# Bytes of text in a chunk and windows in a hash range, on average; least number of either.
CHUNK_BYTES = 4 << 20
RANGE_WINDOWS = 1 << 20
LEAST_GROUPS = 64
# Bytes of a long text split into words at once, and words hashed at once.
PIECE = 4 << 20
WORDS = 1 << 19
# Bases of the two polynomials: odd, so that they have inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CHECK_BYTES = 3  # of the second polynomial
_NO_ID = (1 << 63) - 1
_SPACE = b" \t\n\x0b\x0c\r"


def pieces(text: bytes):
    """The text in parts of about PIECE bytes, cut at white space only."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(_SPACE[i:i + 1], at, at + PIECE) for i in range(len(_SPACE)))
        if cut <= at:  # a word longer than a piece
            found = [text.find(_SPACE[i:i + 1], at + PIECE) for i in range(len(_SPACE))]
            cut = min((f for f in found if f >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of all words of all texts as (words, 2), and words for each text."""
    found, counts, held = [], np.zeros(len(texts), dtype=np.int64), []

    def flush():
        coded = pa.array(held, pa.binary()).dictionary_encode()
        digests = b"".join([xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()])
        table = np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(-1, 2)
        found.append(table[coded.indices.to_numpy()])
        held.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text):
            words = piece.split()
            counts[i] += len(words)
            held += words
            if len(held) >= WORDS:
                flush()
    flush()
    return np.concatenate(found), counts


def rolling(values: np.ndarray, window: int, base: int) -> np.ndarray:
    """The polynomial of every window of ``values``, modulo 2^64, by prefix sums."""
    n = len(values)
    if n < window:
        return np.empty(0, dtype=np.uint64)
    up = np.cumprod(np.full(n, base, dtype=np.uint64))            # base^1 .. base^n
    down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down)])
    return (sums[window:] - sums[:-window]) * up[window - 1:]


class Windows:
    """The windows of some documents, and their distinct hashes in order."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int):
        order = np.argsort(ids, kind="stable")
        hashes, counts = word_hashes([texts[i] for i in order])
        self.window, self.ids = window, ids[order]
        self.ends = np.cumsum(counts)
        self.place = np.empty(len(ids), dtype=np.int64)  # of a document among the sorted ones
        self.place[order] = np.arange(len(ids))
        starts = np.arange(max(0, len(hashes) - window + 1))
        doc = np.searchsorted(self.ends, starts, side="right")
        inside = starts + window <= self.ends[doc] if len(starts) else np.zeros(0, bool)
        self.starts, self.doc = starts[inside], doc[inside]
        first, second = (rolling(hashes[:, i], window, BASES[i])[inside] for i in (0, 1))
        second = (second >> np.uint64(64 - 8 * CHECK_BYTES)).astype(np.uint32)
        by = np.argsort(first, kind="stable")  # of equal windows, the smallest id comes first
        a, b = first[by], second[by]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
            by = np.lexsort((self.doc, second, first))
            a, b = first[by], second[by]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.hash, self.check, self.least = a[new], b[new], self.doc[by[new]]
        self.entry = np.empty(len(a), dtype=np.int64)  # of each window among the distinct ones
        self.entry[by] = np.cumsum(new) - 1

    def bounds(self, ranges: int) -> np.ndarray:
        """Where each range of hash values begins among the distinct ones, and the end."""
        at = (self.hash >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        return np.searchsorted(at, np.arange(ranges + 1, dtype=np.uint64))

    def removed(self, elsewhere: np.ndarray) -> np.ndarray:
        """For each word whether a removed window covers it."""
        again = elsewhere[self.entry] | (self.ids[self.doc] > self.ids[self.least[self.entry]])
        change = np.zeros((self.ends[-1] if len(self.ends) else 0) + 1, dtype=np.int32)
        np.add.at(change, self.starts[again], 1)
        np.add.at(change, self.starts[again] + self.window, -1)
        return np.cumsum(change[:-1]) > 0


def _pack(values: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed (differences of sorted ones have empty high planes)."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _differences(values: np.ndarray) -> np.ndarray:
    return np.concatenate([values[:1], values[1:] - values[:-1]])


_SENT = ("part int, chunk long, n int, hashes binary, checks binary, ranks binary, "
         "docs int, ids binary")
_BACK = "chunk long, part int, n int, bits binary"


def _chunk_windows(table: pa.Table, id_col: str, text_col: str, window: int) -> Windows:
    ids = table.column(id_col).fill_null(_NO_ID).to_numpy()
    texts = [t or b"" for t in table.column(text_col).cast(pa.binary()).to_pylist()]
    return Windows(ids, texts, window)


def _send(id_col: str, text_col: str, window: int, ranges: int):
    """A chunk's distinct windows, a row for each hash range that has some."""
    def run(table: pa.Table) -> pa.Table:
        w = _chunk_windows(table, id_col, text_col, window)
        chunk = table.column("chunk")[0].as_py()
        ids = _pack(_differences(w.ids.astype(np.int64)))
        at = w.bounds(ranges)
        rows = [{"part": p, "chunk": chunk, "n": int(j - i), "hashes": _pack(_differences(w.hash[i:j])),
                 "checks": w.check[i:j].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :CHECK_BYTES].tobytes(), "ranks": _pack(w.least[i:j].astype(np.uint32)),
                 "docs": len(w.ids), "ids": ids}
                for p, (i, j) in enumerate(itertools.pairwise(at.tolist())) if j > i]
        return pa.Table.from_pylist(rows, schema=_arrow(_SENT))
    return run


def _count(table: pa.Table) -> pa.Table:
    """One hash range: for each chunk's entries whether a smaller id has them in another chunk."""
    rows = table.to_pylist()
    sizes = [r["n"] for r in rows]
    hashes = np.concatenate([np.cumsum(_unpack(r["hashes"], r["n"], np.uint64)) for r in rows])
    planes = np.frombuffer(b"".join(r["checks"] for r in rows), np.uint8).reshape(-1, CHECK_BYTES)
    checks = np.pad(planes, ((0, 0), (0, 4 - CHECK_BYTES))).view("<u4").ravel()
    least = np.concatenate([np.cumsum(_unpack(r["ids"], r["docs"], np.int64))
                            [_unpack(r["ranks"], r["n"], np.uint32)] for r in rows])
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    several = order[np.r_[same, False] | np.r_[False, same]]
    several = several[np.lexsort((checks[several], hashes[several]))]
    hit = np.zeros(len(hashes), dtype=bool)
    if len(several):
        h, c = hashes[several], checks[several]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        smallest = np.repeat(np.minimum.reduceat(least[several], new), np.diff(np.r_[new, len(h)]))
        hit[several] = least[several] > smallest
    out = [{"chunk": r["chunk"], "part": r["part"], "n": r["n"], "bits": np.packbits(part).tobytes()}
           for r, part in zip(rows, np.split(hit, np.cumsum(sizes)[:-1])) if part.any()]
    return pa.Table.from_pylist(out, schema=_arrow(_BACK))


def kept_text(text: bytes, removed: np.ndarray) -> bytes:
    """The words that are not removed, joined by one space."""
    parts, at = [], 0
    for piece in pieces(text):
        words = piece.split()
        gone = removed[at:at + len(words)]
        at += len(words)
        if gone.any():
            words = itertools.compress(words, (~gone).tolist())
        parts.append(b" ".join(words))
    return b" ".join(p for p in parts if p)


def _remove(keep: list[str], id_col: str, text_col: str, window: int, ranges: int, schema: pa.Schema):
    """A chunk's documents without the words of removed windows."""
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        w = _chunk_windows(table, id_col, text_col, window)
        elsewhere, at = np.zeros(len(w.hash), dtype=bool), w.bounds(ranges)
        for r in back.to_pylist():
            i, j = at[r["part"]], at[r["part"] + 1]
            if j - i != r["n"]:
                raise ValueError("the documents changed between the two passes")
            elsewhere[i:j] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool)
        removed = w.removed(elsewhere)
        begins = np.r_[0, w.ends]
        edge = np.flatnonzero(np.diff(np.r_[False, removed, False].astype(np.int8)))
        # An interval ends with its document, whatever the next one begins with.
        counts, spans, texts = [], [], []
        for i, text in enumerate(table.column(text_col).cast(pa.binary()).to_pylist()):
            b, e = int(begins[w.place[i]]), int(begins[w.place[i] + 1])
            counts.append(e - b)
            cut = edge[np.searchsorted(edge, b, side="right"):np.searchsorted(edge, e)]
            marks = np.r_[b, cut, e] if e > b else np.zeros(0, np.int64)
            spans.append([{"first": int(x - b), "after": int(y - b)} for x, y in itertools.pairwise(marks)
                          if removed[x]])
            texts.append(kept_text(text or b"", removed[b:e]))
        added = [pa.array(counts, pa.int64()), pa.array(spans, schema.field(len(keep) + 1).type),
                 pa.array(texts, pa.binary()).view(pa.string())]
        return pa.Table.from_arrays([*(table.column(c) for c in keep), *added], schema=schema)
    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Each row with ``n_words``, ``spans`` (removed words as [first, after)) and ``kept``.

    ``kept`` is the text of the words left, joined by one space.  ``keep`` names
    the input columns to carry (default: all).
    """
    keep = list(docs.columns) if keep is None else list(keep)
    key, text = (free_name(n, [*keep, "chunk"]) for n in ("_key", "_body"))
    n_words, spans, kept = (free_name(n, keep) for n in ("n_words", "spans", "kept"))
    chunk = free_name("chunk", keep)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    chunks = max(LEAST_GROUPS, size // CHUNK_BYTES)
    ranges = max(LEAST_GROUPS, size // 7 // RANGE_WINDOWS)  # about seven bytes to a word
    body = F.col(text_col).cast("string")
    deal = F.pmod(F.xxhash64(F.col(id_col), F.crc32(body.cast("binary"))), F.lit(chunks))
    # The carried columns are numbered, so that no name can clash.
    inner = [f"c{i}" for i in range(len(keep))]
    dealt = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, inner)],
                        F.col(id_col).cast("long").alias(key), body.alias(text), deal.alias("chunk"))
    sent = dealt.groupBy("chunk").applyInArrow(_send(key, text, window, ranges), _SENT)
    back = sent.groupBy("part").applyInArrow(_count, _BACK)
    out = T.StructType([T.StructField(n, docs.schema[c].dataType) for c, n in zip(keep, inner)])
    span = T.StructType().add("first", "long").add("after", "long")
    out = out.add("words", "long").add("gone", T.ArrayType(span)).add("left", "string")
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out)
    result = (dealt.groupBy("chunk").cogroup(back.groupBy("chunk"))
              .applyInArrow(_remove(inner, key, text, window, ranges, arrow), out))
    named = [F.col(n).alias(c) for c, n in zip(keep, inner)]
    return result.select(*named, F.col("words").alias(n_words), F.col("gone").alias(spans),
                         F.col("left").alias(kept))
