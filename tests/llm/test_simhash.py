"""SimHash against plain Python: fingerprints bit by bit, components over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from gapseries.llm import simhash
from tests.llm.helpers import DOCS, WORDS, clashing, odd_docs, odd_rows


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 4 else [" ".join(w[i:i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """rows: (id, fingerprint); the smallest id reachable."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


def check(spark, df, rows):
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = sorted(((d, f"{fp:016x}", c) for (d, fp), c in zip(prints, plain_components(prints))), key=str)
    got = simhash.near_duplicates(df.select("doc_id", "text"), keep=["doc_id"]).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_fingerprint():
    for _, text, *_ in odd_rows():
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint("Straße ÄB c D e F".encode()) == plain_fingerprint("Straße ÄB c D e F")


def test_odd_rows(spark):
    check(spark, odd_docs(spark), odd_rows())


def test_near_copies(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        words = rnd.choices(vocabulary, k=400)
        for copy in range(6):
            own = list(words)
            for _ in range(copy):
                own[rnd.randrange(400)] = "other"
            rows.append((len(rows) * 7 % 101, " ".join(own), None, None, None))
    check(spark, spark.createDataFrame(rows, DOCS), rows)


@pytest.mark.parametrize("block", [8, 2048])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, block):
    """A dense cloud of fingerprints: large keys, cut into many blocks, lose no link."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(block)
    centres = [rnd.getrandbits(64) for _ in range(3)]
    prints = {rnd.getrandbits(64) for _ in range(40)}
    for c in centres:
        for _ in range(150):
            x = c
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    rows = [(i, p) for i, p in enumerate(prints)]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    at = {s[0]: i for i, s in enumerate(signed)}
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    for e in edges:
        assert (prints[at[e.a]] ^ prints[at[e.b]]).bit_count() <= 4
        a, b = sorted((find(at[e.a]), find(at[e.b])))
        group[b] = a
    assert [find(i) for i in range(len(prints))] == plain_components(rows)
    assert len(edges) < 60 * len(prints)  # a forest for each key, not all pairs


def test_first_key():
    a = np.array([0, 0, 0], dtype=np.uint64)
    b = np.array([0, 1 << 5, (0b11 << 3) | (1 << 30)], dtype=np.uint64)
    assert simhash._first_key(a, b).tolist() == [0, 5, 30]


def test_drop_keeps_one_of_each(spark):
    df = clashing(odd_docs(spark))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    rows = odd_rows()
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    classes = set(plain_components(prints))
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) and {g for g in got if g is not None} == classes - {None}


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0


def test_clashing_names(spark):
    df = clashing(odd_docs(spark))
    out = simhash.near_duplicates(df)
    assert out.columns == [*df.columns, "_fingerprint", "_component_id"]
    assert out.where("fingerprint = 'x-fingerprint'").count() == df.count()


def test_linked_pairs_share_their_first_tag():
    """Random pairs at every distance up to four: the key that gives the link is a key of both, once."""
    rnd = random.Random(8)
    pairs = []
    for i in range(5000):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), i % 5):
            b ^= 1 << bit
        pairs.append((a, b))
    x, y = (np.array(v, dtype=np.uint64) for v in zip(*pairs))
    tags = simhash._first_tag(x, y)
    k, m = (np.concatenate(list(simhash.variant_keys(v))) for v in (x, y))
    kinds = k >> simhash._VALUE_BITS
    assert (kinds == kinds[:, :1]).all() and len(np.unique(kinds[:, 0])) == len(kinds)
    assert (((kinds == tags) & (k == m)).sum(axis=0) == 1).all()


def test_candidates_stay_few():
    """Random fingerprints meet few others: of 20,000, fewer than one of every hundred meets any."""
    x = np.random.default_rng(5).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    keys = np.concatenate([k.ravel() for k in simhash.variant_keys(x)])
    count = np.unique(keys, return_counts=True)[1]
    assert (count * (count - 1) // 2).sum() < len(x) / 100
