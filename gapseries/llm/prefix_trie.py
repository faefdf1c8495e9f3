"""Conversation prefix trie: the shared openings of conversations, as nodes.

A node of depth d is a distinct sequence of the first d turns (role, text);
its members are the conversations that start with it.  A turn is known by 120
bits of an MD5 of role and text, and texts go no further than that.

Conversations are sorted by their turns and range-sharded.  A task takes its
sorted conversations in blocks of bounded size.  Turn ids of a block lie in
matrices padded with -1, some columns at a time; a lexsort orders the rows,
change masks OR-accumulated over the columns mark where nodes start, and
``reduceat`` aggregates every depth.  Nodes that a block's neighbours may share
are those on the paths of its first and last row: they leave the block as
partial sums and are recombined by key; what they owe their ancestors is summed
along the paths, so a node shared by any number of blocks costs a row of each.

A sequence holds up to ``block_turns`` turns of a conversation (a level).  Only
conversations that share all of them go on, as sequences of a next level under
that node; the rest of a conversation that shares it with no other is one node
for each turn row, never gathered.

Cases: turns are ordered by turn, null first, then by hash of role and text; a
null role or text is empty; rows with a null conversation id take no part;
repeated rows are turns each; a conversation without turns is a member of the
root and ends there; an empty table gives no nodes, not even a root.  Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapseries.llm.common import global_row_number, materialize

# Turns of a conversation gathered at once, and rows and turns a block holds.
BLOCK_TURNS = 512
ROWS = 16_384
CELLS = 1 << 18
COLUMNS = 32
_BITS = 15  # hex digits in each half of a turn's key
_EMPTY = hashlib.sha256(b"").hexdigest()
TURN = "struct<a:bigint,b:bigint,len:bigint>"


def turn_rows(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos from 1, turn key): the turns in order, texts replaced by keys and lengths."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    md5 = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = [F.conv(F.substring(md5, 1 + i * _BITS, _BITS), 16, 10).cast("long") for i in (0, 1)]
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        half[0].alias("a"), half[1].alias("b"), F.length(text).cast("long").alias("len"))
    # Numbered over range partitions, so that a very long conversation is split.
    placed = global_row_number(rows, [F.col("conv").asc(), F.col("turn").asc_nulls_first(),
                                      F.col("a").asc(), F.col("b").asc()], "at")
    first = placed.groupBy(F.col("conv").alias("c")).agg(F.min("at").alias("first"))
    return placed.join(first, F.col("conv") == F.col("c")).select(
        "conv", (F.col("at") - F.col("first") + 1).alias("pos"), F.struct("a", "b", "len").alias("t"))


def with_shared_prefix(turns: DataFrame, base: Column, take: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the opening of another: (ids, turns).

    Conversation c becomes the first ``take`` turns of conversation ``base``
    (expressions of ``conv``), then its own turns after its first ``take``.
    ``take`` must be bounded: a base's opening goes to all built on it.
    """
    turns = materialize(turns, "trie-given")
    convs = materialize(turns.select("conv").distinct().select(
        "conv", base.alias("base"), take.cast("long").alias("take")), "trie-ids")
    own = (turns.join(convs.select(F.col("conv").alias("c"), "take"), F.col("conv") == F.col("c"))
           .where(F.col("pos") > F.col("take")))
    most = convs.agg(F.max("take")).first()[0] or 0
    opening = (turns.where(F.col("pos") <= most)
               .select(F.col("conv").alias("b"), "pos", "t")
               .join(convs.where("take > 0"), F.col("b") == F.col("base"))
               .where(F.col("pos") <= F.col("take")))
    had = (turns.where(F.col("pos") <= most).groupBy(F.col("conv").alias("b"))
           .agg(F.max("pos").alias("had")))
    sizes = (convs.join(had, F.col("b") == F.col("base"), "left")
             .select(F.col("conv").alias("c"), F.least("take", F.coalesce("had", F.lit(0))).alias("used")))
    rest = (own.drop("c").join(sizes, F.col("conv") == F.col("c"))
            .select("conv", (F.col("pos") - F.col("take") + F.col("used")).alias("pos"), "t"))
    return convs.select("conv"), opening.select("conv", "pos", "t").unionByName(rest)


# What a block gives: complete nodes (path null), and the entries of its two paths.
_OUT = ("path long, depth long, key string, parent_key string, conv_id long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, saved_tokens long, len long, ends_sha256 string, "
        "ends string")
_ARROW = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64())
                    for f in _OUT.split(", ")])


class _Block:
    """Sorted conversations of one block, and the nodes they make."""

    def __init__(self, group, conv, leaf, saved, more, sizes, a, b, length, base):
        self.group, self.conv, self.base = group, conv, base
        self.leaf, self.saved, self.more = leaf.copy(), saved.copy(), more
        self.sizes, self.n = sizes, len(conv)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.a, self.b, self.length = a, b, length
        # Ids of the turns of this block, in the order of their keys.
        pairs = np.empty(len(a), dtype=[("a", np.int64), ("b", np.int64)])
        pairs["a"], pairs["b"] = a, b
        self.ids = np.unique(pairs, return_inverse=True)[1].reshape(-1)

    def starts(self):
        """For each depth the rows that reach it and which of them start a node, from 0 down."""
        first = np.r_[True, self.group[1:] != self.group[:-1]]
        node = np.cumsum(first) - 1  # of each row at the depth reached so far
        found = [(np.arange(self.n), first)]
        for at in range(0, int(self.sizes.max(initial=0)), COLUMNS):
            rows = np.flatnonzero(self.sizes > at)
            take = np.arange(at, min(at + COLUMNS, int(self.sizes.max())))
            cell = self.offsets[rows, None] + take
            matrix = np.where(take < self.sizes[rows, None], self.ids[np.minimum(cell, len(self.ids) - 1)], -1)
            order = np.lexsort((self.conv[rows], *matrix.T[::-1], node[rows]))
            rows, matrix = rows[order], matrix[order]
            change = np.ones(matrix.shape, dtype=bool)
            change[1:] = matrix[1:] != matrix[:-1]
            change[1:, 0] |= node[rows[1:]] != node[rows[:-1]]
            change = np.logical_or.accumulate(change, axis=1)
            for j in range(matrix.shape[1]):
                there = matrix[:, j] >= 0
                if there.any():
                    found.append((rows[there], change[there, j]))
            node = node.copy()
            node[rows] = np.cumsum(change[:, -1]) - 1
        return found

    def keys(self, row: int) -> list[str]:
        """Key of the node at each depth of a row's path: a chain of hashes under its group."""
        at = slice(self.offsets[row], self.offsets[row + 1])
        chain, keys = hashlib.md5(self.group[row].encode()), [self.group[row]]
        for pair in np.column_stack([self.a[at], self.b[at]]).astype("<i8"):
            chain.update(pair.tobytes())
            keys.append(chain.hexdigest())
        return keys

    def nodes(self, path: int):
        """Batches of _OUT, from the deepest nodes up; ``path`` numbers the first of the two paths."""
        found, entries = self.starts(), []
        edges = [0, self.n - 1] if self.n > 1 else [0]
        keys = {r: self.keys(r) for r in edges}
        below = None  # start rows of the nodes one deeper, and which of them are shared
        for depth in range(len(found) - 1, -1, -1):
            rows, new = found[depth]
            at, of = np.flatnonzero(new), self._number(found[depth])
            start, m = rows[at], len(at)
            edge = {r: int(of[r]) for r in edges if of[r] >= 0}
            whole = np.ones(m, dtype=bool)
            whole[list(edge.values())] = False
            least = np.minimum.reduceat(self.conv[rows], at)
            count = np.diff(np.r_[at, len(rows)])
            last = self.sizes[rows] == depth
            children = np.add.reduceat((last & self.more[rows]).astype(np.int64), at)
            if below is not None:  # a shared child is counted where it is recombined
                children += np.bincount(of[below[0][below[1]]], minlength=m)
            size = self.length[self.offsets[start] + depth - 1] if depth else np.zeros(m, np.int64)
            np.add.at(self.leaf, start[whole & (children == 0)], 1)
            np.add.at(self.saved, start, np.where(whole, (count - 1) * size, 0))
            leaves = np.add.reduceat(self.leaf[rows], at)
            saved = np.add.reduceat(self.saved[rows], at)
            texts = self._ended(rows, at, last & ~self.more[rows])
            parent, parent_key = None, np.full(m, None, dtype=object)
            if depth:
                up_rows, up_new = found[depth - 1]
                up = self._number(found[depth - 1])
                parent = np.minimum.reduceat(self.conv[up_rows], np.flatnonzero(up_new))[up[start]]
                for r in edge:  # of a shared parent the least member is not known here
                    parent_key[up[start] == up[r]] = keys[r][depth - 1]
            yield self._batch(
                depth=np.full(m, self.base + depth)[whole], parent_key=parent_key[whole], conv_id=least[whole],
                parent_conv_id=parent[whole] if depth else None, n_convs=count[whole],
                n_children=children[whole], n_leaves=leaves[whole], saved_tokens=saved[whole],
                len=size[whole], ends_sha256=[hashlib.sha256(texts[i].encode()).hexdigest() if i in texts
                                              else _EMPTY for i in np.flatnonzero(whole)])
            for side, r in enumerate(edges):
                if r in edge:
                    i = edge[r]
                    # The sums of a node on both paths go with the first.
                    once = 0 if side and edge.get(0) == i else 1
                    entries.append({"path": path + side, "depth": self.base + depth, "key": keys[r][depth],
                                    "parent_key": keys[r][depth - 1] if depth else None,
                                    "conv_id": int(least[i]), "n_convs": int(count[i]) * once,
                                    "n_children": int(children[i]) * once, "n_leaves": int(leaves[i]) * once,
                                    "saved_tokens": int(saved[i]) * once, "len": int(size[i]),
                                    "ends": texts.get(i) if once else None})
            below = (start, whole)
        yield pa.RecordBatch.from_pylist(entries, schema=_ARROW)

    def _number(self, level) -> np.ndarray:
        """The node of every row at a depth, -1 for rows that do not reach it."""
        of = np.full(self.n, -1, dtype=np.int64)
        of[level[0]] = np.cumsum(level[1]) - 1
        return of

    def _ended(self, rows, at, ends) -> dict[int, str]:
        """By node, the ids of the conversations that end there, comma-joined, ascending."""
        node = (np.cumsum(np.isin(np.arange(len(rows)), at)) - 1)[ends]
        ids = self.conv[rows][ends]
        cut = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else []
        return {int(node[i]): ",".join(map(str, part.tolist()))
                for i, part in zip(cut, np.split(ids, cut[1:]) if len(cut) else [])}

    @staticmethod
    def _batch(**columns):
        n = len(columns["depth"])
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, f.type) if columns.get(f.name) is None else pa.array(columns[f.name], f.type)
             for f in _ARROW], schema=_ARROW)


def _shards(base: int, block_rows: int):
    """A task's function: its sorted rows in blocks of at most ``block_rows`` rows or CELLS turns."""
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            turns = batch.column(6)
            sizes = pa.compute.list_value_length(turns).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(sizes)
            at = 0
            while at < batch.num_rows:
                before = upto[at - 1] if at else 0
                to = int(np.searchsorted(upto, before + CELLS, side="right"))
                to = min(max(to, at + 1), at + block_rows, batch.num_rows)
                part = batch.slice(at, to - at)
                flat = part.column(6).flatten()
                a, b, length = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                conv, leaf, saved, more = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
                yield from _Block(np.array(part.column(0).to_pylist(), dtype=object), conv, leaf, saved,
                                  more.astype(bool), sizes[at:to], a, b, length, base).nodes(number)
                number += 2
                at = to
    return run


def _hash_pieces(batches):
    """SHA-256 of each key's id lists, joined by commas; pieces come sorted, one is held at a time."""
    key, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])],
                                          names=["k", "sha"])

    for batch in batches:
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if digest:
                    yield row()
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
    if digest:
        yield row()


def _level(seqs: DataFrame, base: int, block_rows: int) -> DataFrame:
    """Nodes of one level: ``seqs`` has group, conv, leaf, saved, more and turns.

    ``leaf`` and ``saved`` are what the conversation stands for below the level.
    Columns: key (of nodes that blocks share), depth, conv_id, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, own (tokens saved at the node
    alone), ends_sha256, group (of depth-``base`` nodes).
    """
    dealt = seqs.select("group", "conv", "leaf", "saved", "more", F.size("turns").alias("size"), "turns")
    order = ["group", "turns", "conv"]
    found = materialize(dealt.repartitionByRange(*order).sortWithinPartitions(*order)
                        .mapInArrow(_shards(base, block_rows), _OUT), "trie-nodes")
    whole = found.where(F.col("path").isNull())
    paths = found.where(F.col("path").isNotNull())
    # Nodes that several blocks share.
    sums = paths.groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children")], F.max("len").alias("len"),
        F.min("path").alias("holder"))
    sums = materialize(sums, "trie-shared")
    under = sums.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("p")).agg(
        F.count(F.lit(1)).alias("shared_children"))
    own = sums.join(under, F.col("key") == F.col("p"), "left").withColumns({
        "n_children": F.col("n_children") + F.coalesce("shared_children", F.lit(0)),
        "own": (F.col("n_convs") - 1) * F.col("len")}).drop("p", "shared_children")
    own = materialize(own.withColumn("own_leaf", (F.col("n_children") == 0).cast("long")), "trie-own")
    # What each owes its ancestors goes up one path that holds it.
    held = own.select(F.col("key").alias("k"), "holder", "own", "own_leaf")
    entry = paths.join(held, F.col("key") == F.col("k"))
    mine = F.col("path") == F.col("holder")
    upward = Window.partitionBy("path").orderBy(F.col("depth").desc())
    owed = entry.select(
        "key", "n_leaves", "saved_tokens",
        F.sum(F.when(mine, F.col("own_leaf")).otherwise(0)).over(upward).alias("leaves_up"),
        F.sum(F.when(mine, F.col("own")).otherwise(0)).over(upward).alias("saved_up"))
    totals = owed.groupBy(F.col("key").alias("k")).agg(
        F.sum(F.col("n_leaves") + F.col("leaves_up")).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + F.col("saved_up")).alias("saved_tokens"))
    pieces = paths.where(F.col("ends").isNotNull()).select(F.col("key").alias("k"), "path", "ends")
    ended = (pieces.repartition("k").sortWithinPartitions("k", "path")
             .mapInArrow(_hash_pieces, "k string, sha string"))
    parents = own.select(F.col("key").alias("pk"), F.col("conv_id").alias("of"))
    shared = (own.join(totals, F.col("key") == F.col("k")).drop("k")
              .join(ended, F.col("key") == F.col("k"), "left").drop("k")
              .join(parents, F.col("parent_key") == F.col("pk"), "left")
              .select("key", "depth", "conv_id", F.col("of").alias("parent_conv_id"), "n_convs", "n_children",
                      "n_leaves", "saved_tokens", "own", F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256")))
    known = F.col("parent_key").isNull()
    inside = (whole.where(known).withColumn("of", F.col("parent_conv_id"))
              .unionByName(whole.where(~known).join(parents, F.col("parent_key") == F.col("pk")).drop("pk"))
              .select("key", "depth", "conv_id", F.col("of").alias("parent_conv_id"), "n_convs", "n_children",
                      "n_leaves", "saved_tokens", ((F.col("n_convs") - 1) * F.col("len")).alias("own"),
                      "ends_sha256"))
    return shared.unionByName(inside)


_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            "ends_sha256"]


def _gathered(turns: DataFrame, here: DataFrame, base: int, upto: int) -> DataFrame:
    """``here`` (conv, size, group) with the turns of one level, and whether more follow."""
    mine = turns.where((F.col("pos") > base) & (F.col("pos") <= upto))
    if base:
        mine = mine.join(here.select(F.col("conv").alias("c")), F.col("conv") == F.col("c"), "left_semi")
    held = (mine.groupBy(F.col("conv").alias("c"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("x"))
            .select("c", F.transform("x", lambda x: x["t"]).alias("turns")))
    return here.join(held, F.col("conv") == F.col("c"), "left").select(
        "conv", "size", "group", (F.col("size") > upto).alias("more"),
        F.coalesce("turns", F.array().cast(f"array<{TURN}>")).alias("turns"))


def _lone_tails(turns: DataFrame, lone: DataFrame, upto: int) -> DataFrame:
    """The nodes below ``upto`` of conversations that share them with no other: one for each turn."""
    rows = turns.where(F.col("pos") > upto).join(
        lone.select(F.col("conv").alias("c"), "size"), F.col("conv") == F.col("c"))
    last = F.col("pos") == F.col("size")
    return rows.select(
        F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.col("conv").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256))
        .otherwise(F.lit(_EMPTY)).alias("ends_sha256"))


def prefix_trie(ids: DataFrame, turns: DataFrame, *, block_turns: int = BLOCK_TURNS,
                block_rows: int = ROWS) -> DataFrame:
    """All nodes of the conversations ``ids`` (conv) with ``turns`` (conv, pos from 1, t).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns = materialize(turns, "trie-turns")
    sizes = turns.groupBy(F.col("conv").alias("c")).agg(F.max("pos").alias("size"))
    here = ids.join(sizes, F.col("conv") == F.col("c"), "left").select(
        "conv", F.coalesce("size", F.lit(0)).alias("size"), F.lit("").alias("group"))
    # Down: only conversations that share all turns of a level with another go on.
    levels, result = [], []
    tops = None  # (conv_id, leaf, saved): what conversations stand for below a level
    while here is not None:
        base = len(levels) * block_turns
        upto = base + block_turns
        rows = materialize(_gathered(turns, here, base, upto), "trie-level")
        levels.append(rows)
        here = None
        if not rows.where("more").isEmpty():
            chain = F.transform("turns", lambda t: F.concat_ws(",", t["a"], t["b"]))
            under = F.md5(F.concat_ws(";", "group", F.array_join(chain, ";")).cast("binary"))
            full = rows.where(F.size("turns") == block_turns).select("conv", "size", "more", under.alias("group"))
            met = full.groupBy(F.col("group").alias("g")).agg(
                F.count(F.lit(1)).alias("n"), F.max("more").alias("any_more"))
            split = materialize(full.join(met.where("any_more"), F.col("group") == F.col("g"))
                                .select("conv", "size", "group", (F.col("n") > 1).alias("several")), "trie-split")
            tails = _lone_tails(turns, split.where("NOT several"), upto)
            result.append(tails)
            leaf = tails.where("n_children = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"),
                                                        F.lit(0).cast("long").alias("saved"))
            tops = leaf if tops is None else tops.unionByName(leaf)
            if not split.where("several").isEmpty():
                here = split.where("several").select("conv", "size", "group")
    # Up: each level is told what its conversations stand for below it.
    zero, heads = F.lit(0).cast("long"), None
    for n in range(len(levels) - 1, -1, -1):
        rows = levels[n].withColumns({"leaf": zero, "saved": zero})
        if tops is not None:
            below = tops.groupBy(F.col("conv_id").alias("c")).agg(
                F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
            rows = levels[n].join(below, F.col("conv") == F.col("c"), "left").withColumns(
                {"leaf": F.coalesce("leaf", zero), "saved": F.coalesce("saved", zero)})
        nodes = materialize(_level(rows, n * block_turns, block_rows), "trie-result")
        top = F.col("depth") == n * block_turns
        mine = nodes.where(~top) if n else nodes
        if heads is not None:  # the last nodes of this level have their children in the next one
            edge = F.col("depth") == (n + 1) * block_turns
            fixed = mine.where(edge).join(heads, F.col("conv_id") == F.col("c"), "left").withColumn(
                "n_children", F.coalesce("beneath", "n_children")).drop("c", "beneath")
            mine = mine.where(~edge).unionByName(fixed)
        result.append(mine.select(_COLUMNS))
        heads = nodes.where(top).select(F.col("conv_id").alias("c"), F.col("n_children").alias("beneath"))
        own = mine.select("conv_id", (F.col("n_children") == 0).cast("long").alias("leaf"),
                          F.col("own").alias("saved"))
        tops = own if tops is None else tops.unionByName(own)
    nodes = result[0]
    for part in result[1:]:
        nodes = nodes.unionByName(part)
    return nodes
