"""Prefix trie against plain nested dictionaries of whole turn sequences."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapseries.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            md5 = hashlib.md5(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), md5, said))
    return {c: tuple(x[2] for x in sorted(v)) for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(math.fmod(c, 100)), ())[:h] + own[h:]
    return out


def brute(seqs):
    members, children = defaultdict(list), defaultdict(set)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                children[seq[:d - 1]].add(seq[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(seqs[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def plain(spark, rows, **kw):
    """The trie of the conversations as they are."""
    turns = pt.turn_rows(frame(spark, rows))
    out = pt.prefix_trie(turns.select("conv").distinct(), turns, **kw)
    return sorted((tuple(r) for r in out.collect()), key=str)


def shared(spark, rows, **kw):
    """The trie of the conversations rebuilt on the opening of the first of their hundred."""
    c = F.col("conv")
    ids, turns = pt.with_shared_prefix(pt.turn_rows(frame(spark, rows)), c - c % 100,
                                       F.crc32(c.cast("string").cast("binary")) % 6)
    return sorted((tuple(r) for r in pt.prefix_trie(ids, turns, **kw).collect()), key=str)


def talk(n, seed, most=7, kinds=3):
    rng = np.random.default_rng(seed)
    return [(int(c), t, ["user", "assistant", None][t % 3], None if x == 0 else "said " * int(x))
            for c in rng.choice(400, size=n, replace=False) - 150
            for t, x in enumerate(rng.integers(0, kinds, size=rng.integers(1, most)))]


def test_random(spark):
    rows = talk(60, 0)
    assert plain(spark, rows) == brute(in_order(rows))
    assert shared(spark, rows) == brute(rebuilt(in_order(rows)))


@pytest.mark.parametrize("block_rows", [1, 5])
def test_nodes_shared_by_blocks(spark, block_rows):
    rows = talk(50, 4, kinds=2)
    assert plain(spark, rows, block_rows=block_rows) == brute(in_order(rows))


@pytest.mark.parametrize("block_turns,block_rows", [(1, 1000), (2, 3)])
def test_levels(spark, block_turns, block_rows):
    rows = talk(40, 5, most=6, kinds=2)
    assert plain(spark, rows, block_turns=block_turns, block_rows=block_rows) == brute(in_order(rows))


def test_columns_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(pt, "COLUMNS", 3)
    rows = talk(30, 6, most=14, kinds=2)
    assert plain(spark, rows, block_rows=4) == brute(in_order(rows))


def test_odd_rows(spark):
    rows = [(1, None, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, None), (2, 0, "", ""),
            (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", "a"), (None, None, None, None),
            (3, 5, "user", "word " * 20_000), (4, 9, "user", "word " * 20_000), (-7, 0, "us", "er:x"),
            (-107, 0, "user", ":x"), (300, 0, None, "é𝄞"), (301, 1, None, "é𝄞"), (5, -3, "user", "a"), (5, 3, None, "")]
    assert plain(spark, rows) == brute(in_order(rows))
    assert shared(spark, rows, block_rows=2) == brute(rebuilt(in_order(rows)))


def test_turnless_conversations_are_members(spark):
    rows = [(c, 0, "user", "hello") for c in range(101, 130)]  # conversation 100 is absent
    want = brute(rebuilt(in_order(rows)))
    got = shared(spark, rows)
    assert got == want
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 29 and root[7] != hashlib.sha256(b"").hexdigest()


def test_a_third_alike(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(120) for t in range(3)]
    rows += [(c, t, "user", f"t{t if t < 2 else c}") for c in range(120, 360) for t in range(3)]
    assert plain(spark, rows, block_rows=16) == brute(in_order(rows))


def test_one_very_long_conversation(spark):
    rows = [(1, t, "user", f"x{t % 7}") for t in range(200)] + [(2, t, "user", f"x{t % 7}") for t in range(60)]
    assert plain(spark, rows, block_turns=40) == brute(in_order(rows))


def test_empty_and_clashing(spark):
    assert plain(spark, []) == [] and shared(spark, []) == []
    rows = talk(20, 8)
    df = frame(spark, rows).withColumns({n: F.lit(n) for n in ("conv", "pos", "t", "at", "c", "len", "group")})
    turns = pt.turn_rows(df)
    got = pt.prefix_trie(turns.select("conv").distinct(), turns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(in_order(rows))
