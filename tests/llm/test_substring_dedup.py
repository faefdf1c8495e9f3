"""Substring dedup against a plain version, the rolling hash and the texts it leaves."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapseries.llm import substring_dedup as sd
from tests.llm.helpers import DOCS, clashing, odd_docs, odd_rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    """{row place: (words, spans, kept)}; rows are (id, text)."""
    first, docs = {}, []
    for i, text in rows:
        words = WORD.findall((text or "").encode())
        docs.append((sd._NO_ID if i is None else i, words))
        for at in range(len(words) - window + 1):
            key = tuple(words[at:at + window])
            first[key] = min(first.get(key, docs[-1][0]), docs[-1][0])
    out = []
    for i, words in docs:
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at:at + window])] < i:
                gone[at:at + window] = [True] * window
        spans = [(m.start(), m.end()) for m in re.finditer("x+", "".join("x" if g else "." for g in gone))]
        out.append((len(words), spans, b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return out


def run(df, **kw):
    out = sd.remove_repeats(df, **kw).collect()
    return [(r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["kept"]) for r in out]


def check(spark, rows, partitions=3, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = sorted(run(df, **kw), key=repr)
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute(rows, **kw))), key=repr)
    assert got == want


def passages(n, seed, window=13):
    """Texts made of few passages, so that windows repeat inside and across documents."""
    rng = np.random.default_rng(seed)
    stock = [" ".join(f"w{x}" for x in rng.integers(0, 60, size=rng.integers(1, 40))) for _ in range(12)]
    space = [" ", "\n", "  ", "\t"]
    return [(int(rng.integers(0, n)), "".join(stock[rng.integers(12)] + space[rng.integers(4)]
                                              for _ in range(rng.integers(0, 6)))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    check(spark, passages(60, seed), partitions=1 + seed)


def test_other_windows(spark):
    check(spark, passages(40, 7), window=1)
    check(spark, passages(40, 8), window=5)


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()]
    got = sorted(run(odd_docs(spark)), key=repr)
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, brute(rows))), key=repr)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 40)
    monkeypatch.setattr(sd, "WORDS", 16)
    check(spark, [*passages(20, 3), (99, "x" * 500 + " " + "y " * 200 + "z" * 90)])


def test_pieces_are_the_text(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 10)
    for text in (b"", b"   ", b"abc", b"a" * 35, b"ab cd  ef\tgh\nij kl mn op " * 4, b"x" * 30 + b" tail"):
        assert b"".join(sd.pieces(text)) == text
        assert [w for p in sd.pieces(text) for w in p.split()] == text.split()


def test_many_chunks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(sd, "LEAST_GROUPS", 300)
    check(spark, passages(80, 11))
    monkeypatch.setattr(sd, "LEAST_GROUPS", 1)
    check(spark, passages(80, 11))


def test_hot_passage(spark):
    text = " ".join(f"hot{i}" for i in range(30))
    check(spark, [(i, f"own{i} {text} end{i}") for i in range(300)] + [(5, text), (None, text), (None, text)])


def test_columns_are_carried(spark):
    df = clashing(odd_docs(spark)).withColumns({n: F.lit(n) for n in ("n_words", "spans", "kept", "chunk", "_key")})
    out = sd.remove_repeats(df)
    assert out.columns == [*df.columns, "_n_words", "_spans", "_kept"]
    assert sorted(map(str, out.select(df.columns).collect())) == sorted(map(str, df.collect()))


def test_empty_table(spark):
    out = sd.remove_repeats(spark.createDataFrame([], DOCS), keep=["doc_id"])
    assert out.collect() == [] and out.columns == ["doc_id", "n_words", "spans", "kept"]


@pytest.mark.parametrize("window", [1, 2, 13])
def test_rolling_is_the_polynomial(window):
    values = np.random.default_rng(1).integers(0, 1 << 63, size=50).astype(np.uint64)
    got = sd.rolling(values, window, sd.BASES[0])
    for at in range(51 - window):
        want = 0
        for x in values[at:at + window].tolist():
            want = (want * sd.BASES[0] + x) % (1 << 64)
        assert int(got[at]) == want
    assert len(sd.rolling(values[:window - 1], window, sd.BASES[0])) == 0


def test_equal_first_hashes_are_told_apart(monkeypatch):
    """Windows that collide in the full polynomial still differ by the other."""
    def clumsy(values, window, base, real=sd.rolling):
        out = real(values, window, base)
        return out % np.uint64(3) if base == sd.BASES[0] else out

    monkeypatch.setattr(sd, "rolling", clumsy)
    texts = [b"a b c d", b"a b c d e", b"x y z a b c"]
    w = sd.Windows(np.array([1, 2, 3]), texts, 3)
    seen = {}
    for doc, text in enumerate(texts):
        words = text.split()
        for at in range(len(words) - 2):
            seen.setdefault(tuple(words[at:at + 3]), doc)
    assert len(w.hash) == len(seen) and sorted(w.least.tolist()) == sorted(seen.values())


def test_texts_are_shuffled_once(spark):
    import contextlib
    import io
    docs = spark.createDataFrame(passages(50, 1), "doc_id long, text string")
    out = sd.remove_repeats(docs)
    out.collect()
    with contextlib.redirect_stdout(io.StringIO()) as said:
        out.explain()
    assert "ReusedExchange" in said.getvalue()
