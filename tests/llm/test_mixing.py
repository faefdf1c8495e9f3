"""Mixing against plain water-filling, and the cut search against a sort."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gapseries.llm import mixing
from tests.llm.helpers import DOCS, WORDS, clashing, odd_docs, odd_rows

CYCLE = [5.0, 2.0, 1.0]


def plain_targets(sizes, weights, epochs=3):
    """Clamp what is above, share the rest again, until nothing is above."""
    total, clamped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in clamped)
        weight = sum(w for s, w in weights.items() if s not in clamped)
        share = {s: left * w / weight for s, w in weights.items() if s not in clamped}
        over = {s for s, t in share.items() if t > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in clamped else share[s] for s in sizes}
        clamped |= over


def plain_taken(rows, targets):
    """rows: (id, size, source) -> taken for each row, by sorting each source's documents."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[2], []).append(r)
    out = []
    for source, own in by_source.items():
        size = sum(r[1] for r in own)
        whole = int(targets[source] // size) if size else 0
        extra, before = targets[source] - whole * size, 0
        key = lambda r: int(hashlib.md5(f"42|{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16)
        for r in sorted(own, key=key):
            out.append((r[0], r[1], r[1] * (whole + (before + r[1] / 2 <= extra))))
            before += r[1]
    return out


def mixed(df, **kw):
    return mixing.mix_sources(df, lambda s: mixing.cyclic_weights(s, CYCLE), **kw)


def by_rank(sources):
    return {s: CYCLE[i % 3] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


@pytest.mark.parametrize("hot", [0, 3000])
def test_against_sorting(spark, hot):
    rows = [(i, (i * 37) % 50 if i % 9 else 0, f"s{i % 7}") for i in range(300)]
    rows += [(10_000 + i, 3 + i % 5, "s0") for i in range(hot)]
    df = spark.createDataFrame(rows, "doc_id long, n int, source string").withColumn(
        "text", F.expr("repeat('w ', n)"))
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    targets = plain_targets(sizes, by_rank(sizes))
    got = mixed(df).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in got) == sorted(plain_taken(rows, targets))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.size * r.repeats <= 3 * r.size
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - targets[s]) <= 25


def test_repeated_id_holds_most_rows(spark):
    """Rows that share an id are separate documents; the mix still meets its targets."""
    rows = [(7, "one two three", "a")] * 500 + [(i, "x y", "b") for i in range(40)]
    got = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = {s: sum(r.taken for r in got if r.source == s) for s in "ab"}
    target = {r.source: r.target for r in got}
    assert all(abs(taken[s] - target[s]) <= 3 for s in "ab") and len(got) == 540


def test_reruns_agree(spark):
    df = odd_docs(spark)
    first, second = (sorted(map(str, mixed(df).select("doc_id", "taken").collect())) for _ in range(2))
    assert first == second


def test_odd_rows_and_clashing_names(spark):
    df = clashing(odd_docs(spark))
    out = mixed(df)
    assert out.columns == [*df.columns, "_size", "source_size", "_target", "_repeats", "_taken"]
    rows = out.collect()
    assert len(rows) == len(odd_rows())
    assert sorted(r["_size"] for r in rows) == sorted(len(WORDS.findall(r[1] or "")) for r in odd_rows())
    copies = mixing.expand(out, df.columns, "_repeats")
    assert copies.columns == df.columns and copies.count() == sum(r["_repeats"] for r in rows)


def test_all_clamped_empty_and_wordless(spark):
    one = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixed(one, total_share=100.0).collect()] == [(6.0, 6)]
    assert mixed(spark.createDataFrame([], DOCS)).count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixed(blank).collect()] == [(0, 0.0, 0)] * 2


def test_no_document_above_the_epoch_cap(spark):
    """Also not the empty texts of a source at its clamp."""
    rows = [(i, "" if i % 3 else "one two three", None, "big" if i % 10 else "small", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix_sources(docs, lambda s: s.withColumn("weight", F.when(F.col("source") == "small", 50.0)
                                                            .otherwise(1.0)), max_epochs=3)
    assert {r.repeats for r in mixed.where("source = 'small'").collect()} == {3}
    assert mixed.agg(F.max("repeats")).first()[0] <= 3
    copies = mixing.expand(mixed, docs.columns).groupBy("doc_id").count()
    assert copies.agg(F.max("count")).first()[0] <= 3


def test_repeated_ids_do_not_depend_on_the_layout(spark):
    rows = [(7, f"text number {i} " + "word " * (i % 5), None, "a" if i % 2 else "b", 0) for i in range(300)]
    rows += [(None, None, None, None, None)] * 3
    told = []
    for n in (1, 3, 5):
        mixed = mixing.mix_sources(spark.createDataFrame(rows, DOCS).repartition(n),
                                   lambda s: mixing.cyclic_weights(s, [5.0, 1.0]), total_share=0.5)
        told.append(sorted((str(r.text), r.taken, r.repeats) for r in mixed.collect()))
    assert told[0] == told[1] == told[2]
    assert len({t for _, t, _ in told[0]}) > 1
