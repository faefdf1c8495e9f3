"""Greedy string tiling against a plain version; planted, reordered and clean documents."""

import random

import numpy as np
import pytest

from gapseries.llm import decontaminate as dc
from tests.conftest import SF001
from tests.llm.helpers import DOCS, clashing, odd_docs

BENCH = "item_id long, text string"


def plain_tiling(a, b, least):
    """Longest common run of unmarked words, marked, again and again; the number covered."""
    ma, mb, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best, places = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not (ma[i + k] or mb[j + k]):
                    k += 1
                if k > best:
                    best, places = k, [(i, j)]
                elif k == best and k >= least:
                    places.append((i, j))
        if not places:
            return covered
        for i, j in places:
            if not any(ma[i:i + best]) and not any(mb[j:j + best]):
                ma[i:i + best] = [True] * best
                mb[j:j + best] = [True] * best
                covered += best


@pytest.mark.parametrize("seed", range(30))
def test_tiling(seed):
    rnd = random.Random(seed)
    words = rnd.choice([3, 6, 40])
    a = [rnd.randrange(words) for _ in range(rnd.randint(5, 60))]
    b = [rnd.randrange(words) for _ in range(rnd.randint(0, 60))]
    for _ in range(3):  # shared passages
        i = rnd.randrange(len(a))
        j = rnd.randrange(len(b) + 1)
        b[j:j] = a[i:i + rnd.randint(3, 30)]
    tiles = dc.tile(np.array(a), np.array(b), 5)
    covered = set()
    for i, d, n in tiles:
        assert n >= 5 and a[i:i + n] == b[d:d + n]
        assert not covered & set(range(i, i + n))
        covered |= set(range(i, i + n))
    assert sum(t[2] for t in tiles) == len(covered)
    if words == 40:  # with few words, equal runs leave a choice that changes what is left
        assert len(covered) == plain_tiling(a, b, 5)


ITEM = "Alpha beta gamma delta epsilon. Zeta eta theta iota kappa, lambda mu nu xi omicron!"
OTHER = "one two three four five six seven eight nine ten eleven twelve"


def leaks(spark, docs, bench, **kw):
    rows = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(bench, BENCH), **kw).collect()
    return sorted((r.doc_id, r.item_id) for r in rows)


def test_planted(spark):
    noise = "lorem ipsum dolor sit amet " * 30
    docs = [(1, noise + ITEM + noise), (2, noise), (3, "zeta ETA theta iota, kappa. " + noise + "Lambda mu nu xi omicron "
            + noise + "alpha beta gamma delta epsilon"),
            (4, noise + "Alpha beta gamma delta epsilon " + noise), (5, ITEM + " " + OTHER), (6, None), (7, ""),
            (8, "alpha beta zeta eta gamma delta theta iota lambda mu"), (1, noise + ITEM + noise)]
    bench = [(10, ITEM), (11, OTHER), (12, None), (13, ""), (14, "!!"), (15, "tiny item"), (11, OTHER)]
    assert leaks(spark, docs, bench) == [(1, 10), (1, 10), (3, 10), (5, 10), (5, 11), (5, 11)]
    assert leaks(spark, [(1, "a tiny item here"), (2, "tiny little item")], bench) == [(1, 15)]
    # The same in many blocks.
    assert leaks(spark, docs, bench, block_chars=20) == [(1, 10), (1, 10), (3, 10), (5, 10), (5, 11), (5, 11)]


def test_tiles_point_at_the_words(spark):
    text = "x y z " * 40 + ITEM
    row = dc.find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"),
                        spark.createDataFrame([(10, ITEM)], BENCH)).first()
    assert row.coverage == 1.0 and row.covered == row.item_words == len(dc.words(ITEM))
    for t in row.tiles:
        assert dc.words(text)[t.doc_start:t.doc_start + t.length] == \
            dc.words(ITEM)[t.item_start:t.item_start + t.length]


def test_drop(spark):
    docs = clashing(odd_docs(spark))
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again")], BENCH)
    for chars in (dc.BLOCK_CHARS, 5):
        kept = dc.drop_leaks(docs, bench, block_chars=chars)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "5", "6", "7", "9", "None", "None"]
    none = spark.createDataFrame([], BENCH)
    assert dc.drop_leaks(docs, none).count() == docs.count() and dc.find_leaks(docs, none).count() == 0
    assert dc.find_leaks(spark.createDataFrame([], DOCS), bench).count() == 0


def test_given_tables_against_containment(spark):
    """Documents that hold an item word for word are found; all found are covered for 80 %."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    items = {r.item_id: " ".join(dc.words(r.text)) for r in bench.collect()}
    found = dc.find_leaks(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    for r in docs.collect():
        text = " ".join(dc.words(r.text))
        for k, item in items.items():
            if f" {item} " in f" {text} ":
                assert (r.doc_id, k) in pairs
    assert pairs and all(r.coverage >= 0.8 for r in found)


def test_a_long_passage_of_a_long_item(spark):
    rnd = random.Random(5)
    item = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    noise = "lorem ipsum dolor sit amet " * 20
    docs = [(1, noise + " ".join(item[40:190]) + " " + noise), (2, noise + " ".join(item[40:85]) + " " + noise),
            (3, " ".join(" ".join(item[i:i + 20]) + " stop " for i in range(0, 120, 20)))]
    bench = [(9, " ".join(item))]
    assert leaks(spark, docs, bench) == [(1, 9)]
    assert leaks(spark, docs, bench, passage_words=45) == [(1, 9), (2, 9)]
    assert leaks(spark, docs, bench, passage_words=1000) == []


def test_reach_is_the_words_under_the_seeds():
    rnd = random.Random(1)
    rows = [(k, " ".join(str(rnd.randrange(4)) for _ in range(rnd.randint(5, 30)))) for k in range(40)]
    bench = dc.Benchmark(rows)
    seeds = np.unique(bench.seeds[5][0])[::3]
    got = dict(zip(*(x.tolist() for x in bench._reach(5, seeds))))
    want = {}
    for k, words in enumerate(bench.items):
        under = np.zeros(len(words), bool)
        for i, h in enumerate(dc._window_hashes(dc._codes(words), 5)):
            if h in seeds:
                under[i:i + 5] = True
        if under.any():
            want[k] = int(under.sum())
    assert got == want


def test_a_large_benchmark_costs_a_document_little():
    """Many items that share common phrases: only places of the document's seeds are looked at."""
    import time
    rnd = random.Random(2)
    phrases = [" ".join(f"p{rnd.randrange(900)}" for _ in range(8)) for _ in range(50)]
    rows = [(k, " ".join([*(f"w{rnd.randrange(50000)}" for _ in range(20)), rnd.choice(phrases),
                          *(f"w{rnd.randrange(50000)}" for _ in range(20))])) for k in range(20_000)]
    bench = dc.Benchmark(rows)
    docs = [" ".join([*(f"w{rnd.randrange(50000)}" for _ in range(300)), phrases[i],
                      *(f"w{rnd.randrange(50000)}" for _ in range(300))]) for i in range(20)]
    began = time.process_time()
    assert not any(list(bench.leaks(d)) for d in docs)
    assert (time.process_time() - began) / len(docs) < 0.05
    assert [k for k, *_ in bench.leaks("x y " + rows[777][1])] == [777]
