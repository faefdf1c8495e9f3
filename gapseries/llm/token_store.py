"""Token ids in binary files of independent zstandard frames.

A file holds frames of whole documents, a frame with the index of documents,
and a trailing seek table in the public seekable-zstd layout: for each frame
its compressed size, its size and a checksum.  A reader fetches the tail and
decompresses only the frames that hold the documents asked for; any zstd tool
can decompress the file as a whole.

Files are written by the tasks into a folder all executors share, under names
of their own, and become part of the result only through the manifest that the
finished tasks return, so a task that runs again leaves nothing but an unused
file.

Cases: a null text is empty (one end id); ids ascend, null ids come first and
repeated rows follow each other; very long texts fill a frame alone; an empty
table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapseries.llm.common import materialize, worker_state
from gapseries.session import scratch_path

# The seekable-zstd layout (fixed by its public specification).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
FRAME_IDS = 1 << 17  # ids in a frame
CACHE_WORDS = 300_000  # words that a worker remembers
GROUP_BYTES = 8 << 20  # text whose words are looked up together
GATHER_WORDS = 200_000  # words whose ids are put together at once
RUN_WORDS = 32  # new words encoded as one text
NULL_ID = -(1 << 63)

MANIFEST = "path string, first_id long, docs long, ids long, bytes long"


# ------------------------------------------------------------------ format ---
class FrameWriter:
    """Writes one file: ``add`` documents in order, then ``close``."""

    def __init__(self, out, level: int = 3):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table, self.index, self.held, self.held_ids, self.size = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        n = len(ids) // 4
        self.index.append((NULL_ID if doc_id is None else doc_id, len(self.table), self.held_ids, n))
        self.held.append(ids)
        self.held_ids += n
        if self.held_ids >= FRAME_IDS:
            self._frame()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _frame(self) -> None:
        data = b"".join(self.held)
        packed = self.zstd.compress(data)
        self._put(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.held_ids = [], 0

    def close(self) -> int:
        """Write what is held, the index and the seek table; the file's size."""
        if self.held:
            self._frame()
        index = np.array(self.index, dtype="<i8").reshape(-1, 4).tobytes()
        packed = self.zstd.compress(index)
        self._put(packed)
        self.table.append((len(packed), len(index), xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        body = b"".join(struct.pack("<III", *row) for row in self.table)
        body += struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self._put(struct.pack("<II", SKIPPABLE, len(body)) + body)
        return self.size


class FrameReader:
    """Reads a file written by :class:`FrameWriter`, frame by frame."""

    def __init__(self, source):
        """``source``: a seekable binary file."""
        self.source = source
        source.seek(0, os.SEEK_END)
        size = source.tell()
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table")
        rows = np.frombuffer(self._read(size - 9 - 12 * frames, 12 * frames), dtype="<u4").reshape(-1, 3)
        self.table = rows.astype(np.int64)
        self.offsets = np.r_[0, np.cumsum(self.table[:, 0])]
        self.index = np.frombuffer(self._frame(frames - 1), dtype="<i8").reshape(-1, 4)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _frame(self, k: int) -> bytes:
        packed, size, check = (int(x) for x in self.table[k])
        data = zstandard.ZstdDecompressor().decompress(self._read(int(self.offsets[k]), packed),
                                                       max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, wanted=None):
        """(doc_id, ids) in file order; only the frames that hold ``wanted`` ids are read."""
        rows = self.index if wanted is None else \
            self.index[np.isin(self.index[:, 0], np.fromiter(wanted, dtype=np.int64))]
        held, data = -1, b""
        for doc_id, frame, at, n in rows.tolist():
            if frame != held:
                held, data = frame, self._frame(frame)
            yield (None if doc_id == NULL_ID else doc_id), np.frombuffer(data, "<u4", n, 4 * at)


def _open(path: str, mode: str):
    """A file of any store that Arrow reaches, by its URI (local paths too)."""
    from pyarrow import fs
    uri = re.sub(r"^(\w+):/(?!/)", r"\1:///", path)
    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(inner, compression=None) if mode == "w" else system.open_input_file(inner)


# ---------------------------------------------------------------- tokenizer ---
# The settings under which a text's ids are those of its words in turn.
WORDWISE_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDWISE_SPLIT = {
    "type": "Split", "behavior": "Removed", "invert": True,
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}}


def make_encoder(path: str):
    """The encoder for a tokenizer file: word by word where that is exact, else of whole texts."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    split = (config["pre_tokenizer"] or {}).get("pretokenizers", [None])[0]
    wordwise = (config["normalizer"] == WORDWISE_NORMALIZER and split == WORDWISE_SPLIT
                and config["post_processor"] is None and not any(
                    t["lstrip"] or t["rstrip"] or t["single_word"] for t in config["added_tokens"]))
    return WordEncoder(path) if wordwise else TextEncoder(path)


class TextEncoder:
    """Encodes whole texts with the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (no nulls) as little-endian unsigned 32-bit integers."""
        return self._ids(texts.to_pylist())


class WordEncoder(TextEncoder):
    """Encodes the distinct words of many texts, and puts the texts' ids together.

    The tokenizer treats white space as nothing but a border, ignores case and
    cuts between letters and marks; ASCII white space and marks compose with no
    letter before them.  So the ids of a text are those of its words in turn,
    in lower case, with closing marks as words of their own.  Arrow cuts the
    texts and numbers the distinct words; a worker remembers the ids of words it
    has met, in two generations of a fixed size.  New words go to the tokenizer
    in runs, set apart by a control character that is one id of its own; words
    that hold the character go alone, as do texts in which case may count.
    """

    MARK, SPACED = "\x01", " \x01 "
    # An ASCII or Latin-1 letter, then an ASCII mark but the apostrophe and those of special tokens.
    CUT = "([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-;=?@\\[-`{}~])"
    LETTERS = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
    # Special tokens, and the dot above, which makes of I a letter whose lower case is two.
    CASED = "<\\||\u0307"

    def __init__(self, path: str):
        super().__init__(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        alone, spaced, joined, a = self._ids([self.MARK, f"a{self.SPACED}a", f"a{self.MARK}a", "a"])
        if len(alone) != 4 or spaced != a + alone + a or joined != spaced:
            raise ValueError("the tokenizer has no id for the mark between words")
        self.mark = int.from_bytes(alone, "little")

    def _learn(self, words: list[str], between: str) -> None:
        """Ids of words without MARK, encoded in runs with ``between`` among them."""
        runs = [words[at:at + RUN_WORDS] for at in range(0, len(words), RUN_WORDS)]
        for run, raw in zip(runs, self._ids([between.join(run) for run in runs])):
            start = 0
            cuts = np.flatnonzero(np.frombuffer(raw, "<u4") == self.mark).tolist()
            for w, cut in zip(run, [*cuts, len(raw) // 4], strict=True):
                self.young[w] = raw[4 * start:4 * cut]
                start = cut + 1

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self.young.get, words))
        missing = [w for w, x in zip(words, found) if x is None]
        if missing:
            new = []
            for w in missing:
                ids = self.old.get(w)
                if ids is None:
                    new.append(w)
                else:
                    self.young[w] = ids
            letters, others = [], []
            for w in new:
                (letters if w.isascii() and w.isalpha() or self.LETTERS.fullmatch(w) else others).append(w)
            self._learn(letters, self.MARK)  # other words could join a mark without a space
            self._learn([w for w in others if self.MARK not in w], self.SPACED)
            alone = [w for w in others if self.MARK in w]
            self.young.update(zip(alone, self._ids(alone)))
            ids_of = self.young.__getitem__
            found = [ids_of(w) if x is None else x for w, x in zip(words, found)]
        if len(self.young) > CACHE_WORDS // 2:
            self.old, self.young = self.young, {}
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        # A copy that starts at offset 0: pyarrow 23 lower-cases slices of large strings wrongly.
        texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
        whole = pc.match_substring_regex(texts, self.CASED).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), self.CUT, r"\1 \2")
        lists = pc.ascii_split_whitespace(cut)
        coded = lists.flatten().dictionary_encode()
        offsets, index = lists.offsets.to_numpy(), coded.indices.to_numpy()
        offsets, index = offsets - offsets[0], index.astype(np.int64)
        ids = self._ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        first = np.cumsum(size) - size
        out, at = [], 0
        while at < len(texts):  # texts of about GATHER_WORDS words at a time
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GATHER_WORDS, side="right")) - 1)
            words = index[offsets[at]:offsets[to]]
            n = size[words]
            ends = np.cumsum(n)
            raw = pool[np.repeat(first[words] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            ends = np.r_[0, ends][offsets[at:to + 1] - offsets[at]].tolist()
            out.extend(raw[4 * a:4 * b] for a, b in zip(ends, ends[1:]))
            at = to
        for k in np.flatnonzero(whole).tolist():
            out[k] = self._ids([texts[k].as_py()])[0]
        return out


def encode_all(encoder, texts: pa.Array):
    """The ids of each text of a column (null: none), GROUP_BYTES of text at a time.

    A longer text is cut at ASCII white space into parts for a word encoder.
    """
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + GROUP_BYTES, side="right")))
        group = pc.fill_null(texts.slice(at, to - at), "")
        if to == at + 1 and size[at] > GROUP_BYTES and isinstance(encoder, WordEncoder):
            parts = _parts(group[0].as_py())
            yield b"".join(b"".join(encoder.encode(pa.array([p], pa.string()))) for p in parts)
        else:
            yield from encoder.encode(group)
        pa.default_memory_pool().release_unused()
        at = to


def _parts(text: str):
    """A long text in parts of about GROUP_BYTES characters, cut at ASCII white space."""
    at = 0
    for gap in re.finditer(r"[\x20\x09-\x0D]", text):
        if gap.start() - at >= GROUP_BYTES:
            yield text[at:gap.start()]
            at = gap.start()
    yield text[at:]


# --------------------------------------------------------------------- jobs ---
def write_tokens(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode all documents into files, in ascending id order; return the manifest.

    A file for each range of ids, the ranges in order: (path, first_id, docs,
    ids, bytes).  ``path`` is a folder that all executors reach (default: under
    the checkpoint folder).
    """
    spark = docs.sparkSession
    folder = path or scratch_path(spark, "token-files")
    if re.match(r"file:|/", folder):
        from pyarrow import fs
        system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))
        system.create_dir(inner, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("by_text"),
                       # Deals out the rows of an id that repeats with its text.
                       F.xxhash64(F.monotonically_increasing_id()).alias("copy"))
    # Rows that share an id are ordered by their texts, whatever the layout.
    order = [F.col("id").asc_nulls_first(), F.col("by_text"), F.col("copy")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    end = struct.pack("<I", end_id)

    def run(batches):
        encoder = worker_state(f"encoder:{tokenizer_path}", lambda: make_encoder(tokenizer_path))
        target, writer, first, docs_n, ids_n = f"{folder}/{uuid.uuid4().hex}.ids.zst", None, None, 0, 0
        out = None
        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), encode_all(encoder, batch.column(1))):
                if writer is None:
                    out = _open(target, "w")
                    writer, first = FrameWriter(out), i
                writer.add(i, ids + end)
                docs_n, ids_n = docs_n + 1, ids_n + len(ids) // 4 + 1
        if writer is not None:
            size = writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": target, "first_id": first, "docs": docs_n,
                                               "ids": ids_n, "bytes": size}], schema=schema)

    schema = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("docs", pa.int64()),
                        ("ids", pa.int64()), ("bytes", pa.int64())])
    files = dealt.mapInArrow(run, MANIFEST).withColumn("part", F.spark_partition_id())
    return materialize(files, "token-manifest")


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, ids_crc32) for each document.

    ``start``: ids of all documents before it, over all files.
    """
    before = F.sum("ids").over(Window.orderBy("part")) - F.col("ids")  # a row for each file
    files = manifest.withColumn("before", before).select("path", "before", "part")

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(path, "r") as source:
                    rows, at = [], base
                    for doc_id, ids in FrameReader(source).documents():
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids)))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in zip(*rows)],
                        names=[id_col, "start", "n_tokens", "ids_crc32"])

    # A task for each file: the count is given, as the manifest's few bytes would else make one task.
    return files.repartitionByRange(max(1, manifest.count()), "part").select("path", "before").mapInArrow(
        run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, wanted: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of a few documents, decompressing only their frames."""
    found: dict[int, list[np.ndarray]] = {}
    for row in manifest.select("path").toLocalIterator():
        with _open(row.path, "r") as source:
            for doc_id, ids in FrameReader(source).documents(wanted):
                found.setdefault(doc_id, []).append(ids)
    return found
