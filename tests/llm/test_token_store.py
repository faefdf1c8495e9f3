"""Token files: exact round trip, frames read one by one, damage noticed."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gapseries.llm import token_store as ts
from gapseries.llm.queries import tokenizer_path
from tests.conftest import SF001
from tests.llm.helpers import DOCS, clashing, odd_docs, odd_rows

ODD_TEXTS = ["", " ", "Don't stop! it's 3.14\n\nÀé ÉCOLE ﬁ Straße", "a<|endoftext|>b <|startoftext|>",
             "x́ ́y\t\x1c\x85z w v", "ΑΣ ΣΑΣ İstanbul", "日本語 テスト 🙂🙂 ée",
             "\x0b\x0cend 's 't ' s"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_give_the_ids_of_the_whole_text(tokenizer, spark):
    encoder = ts.make_encoder(tokenizer_path())
    assert isinstance(encoder, ts.WordEncoder)
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    for text, ids in zip(texts, encoder.encode(pa.array(texts, pa.string()))):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_any_mixture_of_characters(tokenizer):
    """Random words over characters that could compose, fold or join across a cut."""
    rnd = random.Random(5)
    pieces = list("aZzIKé ßÄ÷×.,;:!?$%&#*()'<|>=/\\-_~`^\"@[]{}+09\x01\x1c") + [
        "\u0301", "\u0307", "\u0338", "İ", "ı", "ﬁ", "K", "Å", "日", "🙂", "'s", "'t", "'RE", "\u00a0", "\u2003",
        "\u0345", "<|endoftext|>", "<|ENDOFTEXT|>", "…", "ǅ", "\u0958", "e\u0301", "µ", "ª", "\t", "\n"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randint(1, 30))) for _ in range(4000)]
    encoder = ts.WordEncoder(tokenizer_path())
    for text, ids in zip(texts, encoder.encode(pa.array(texts, pa.string()))):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_encode_whole_texts():
    path = tokenizer_path("byte_bpe_50k.json")
    encoder, plain = ts.make_encoder(path), Tokenizer.from_file(path)
    assert type(encoder) is ts.TextEncoder
    for text, ids in zip(ODD_TEXTS, encoder.encode(pa.array(ODD_TEXTS))):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("sizes", [(8, 5, 2), (1000, 1, 64), (10, 1000, 1)])
def test_small_cache_groups_and_runs(monkeypatch, tokenizer, sizes):
    for name, value in zip(("CACHE_WORDS", "GATHER_WORDS", "RUN_WORDS"), sizes):
        monkeypatch.setattr(ts, name, value)
    encoder = ts.WordEncoder(tokenizer_path())
    texts = [" ".join(f"Word{i % 13}, {i} \x01 \x01\x01a b\x01 x{'yz' * (i % 50)}!" for i in range(n))
             for n in (200, 0, 1, 37)]
    for _ in range(3):
        for text, ids in zip(texts, encoder.encode(pa.array(texts, pa.string()))):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.young) <= sizes[0] and len(encoder.old) <= 1100


def test_slices_of_a_column(tokenizer, spark):
    texts = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    column = pa.array(texts, pa.string())
    encoder = ts.make_encoder(tokenizer_path())
    for at in (0, 1, 77, 150):
        for text, ids in zip(texts[at:at + 50], encoder.encode(column.slice(at, 50))):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_long_texts_in_parts(monkeypatch, tokenizer, size):
    monkeypatch.setattr(ts, "GROUP_BYTES", size)
    texts = ["one two\n three", None, "", "x" * 50 + " é y. " * 40, "word. " * 30, " \t "]
    got = list(ts.encode_all(ts.make_encoder(tokenizer_path()), pa.array(texts, pa.string())))
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_round_trip(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(ts, "FRAME_IDS", 64)
    rows = odd_rows() + [(100 + i, t, None, None, None) for i, t in enumerate(ODD_TEXTS)]
    manifest = ts.write_tokens(spark.createDataFrame(rows, DOCS), tokenizer_path())
    got = sorted(ts.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda d: (d is not None, d))
    want = {}
    for d, text, *_ in rows:
        ids = whole(tokenizer, text)
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(want.values())
    some = ts.read_documents(manifest, [5, 102])
    assert some[102][0].tolist() == whole(tokenizer, ODD_TEXTS[2]) and len(some[5][0]) > 80_000


def test_only_wanted_frames_are_read(monkeypatch):
    monkeypatch.setattr(ts, "FRAME_IDS", 10)
    out = io.BytesIO()
    w = ts.FrameWriter(out)
    for i in range(20):
        w.add(i, np.full(7, i, "<u4").tobytes())
    w.close()
    reader, asked = ts.FrameReader(out), []
    frame = reader._frame
    reader._frame = lambda k: asked.append(k) or frame(k)
    assert [(d, x.tolist()) for d, x in reader.documents([13])] == [(13, [13] * 7)]
    assert len(asked) == 1 and len(reader.table) == 11
    # Any zstd reader gets the ids, then the index, over all frames.
    everything = zstandard.ZstdDecompressor().stream_reader(out.getvalue(), read_across_frames=True).read()
    assert np.frombuffer(everything[:20 * 28], "<u4").tolist() == [i for i in range(20) for _ in range(7)]


def test_damage_is_noticed():
    out = io.BytesIO()
    w = ts.FrameWriter(out)
    w.add(1, np.arange(1000, dtype="<u4").tobytes())
    w.close()
    raw = bytearray(out.getvalue())
    raw[40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(ts.FrameReader(io.BytesIO(bytes(raw))).documents())
    good = bytearray(out.getvalue())
    good[-1] ^= 1
    with pytest.raises(ValueError):
        ts.FrameReader(io.BytesIO(bytes(good)))


def test_empty_and_clashing(spark):
    assert ts.read_tokens(ts.write_tokens(spark.createDataFrame([], DOCS), tokenizer_path())).count() == 0
    df = clashing(odd_docs(spark))
    assert ts.read_tokens(ts.write_tokens(df, tokenizer_path())).count() == df.count()


def test_a_task_reads_each_file(spark):
    """Also where the manifest is tiny and shuffles have many partitions."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = ts.write_tokens(docs.repartition(4), tokenizer_path())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        files = manifest.count()
        read = ts.read_tokens(manifest)
        tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert files > 4 and tasks == files
    assert read.count() == 400


def test_repeated_ids_do_not_depend_on_the_layout(spark):
    rows = [(i % 3, f"words of text {i}") for i in range(60)] + [(1, None), (None, "x"), (1, "same"), (1, "same")]
    told = [sorted(map(str, ts.read_tokens(ts.write_tokens(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(n), tokenizer_path())).collect()))
        for n in (1, 5)]
    assert told[0] == told[1]
