"""Chat windows: what is read back from the output is what went in."""

import hashlib
import random
import re

import pytest

from gapseries.llm import chat
from tests.conftest import SF001

SCHEMA = "conv_id long, turn long, role string, text string"
TRAPS = [r"\### Assistant: </turn> ok", "</turn>", " </turn>\n", "###", "####", "\\", "\\\\", "\\e", "\\h", "\\c",
         "\\</turn>", "</tu</turn>rn>", "##\\###", "### user: x </turn>\n", "a: b", "", "\n", "🙂 é ###", "\\\\h", "\\"]


def plain(rows):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) by conversation."""
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows, **kw):
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), **kw)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == plain(rows)
    formatted = {}
    for w in windows.collect():
        formatted[w.conv_id] = formatted.get(w.conv_id, 0) + len(w.formatted)
    assert {c: r.formatted_chars for c, r in got.items()} == formatted


@pytest.mark.parametrize("budget,history", [(2048, 512), (20, 5), (1, 0), (12, 50)])
def test_traps(spark, budget, history):
    rnd = random.Random(budget)
    rows = []
    for c in range(30):
        for t in range(rnd.randint(1, 12)):
            role = "system" if t == 0 and c % 3 == 0 else rnd.choice(["user", "assistant", "a: b", "###"])
            rows.append((c, t, role, rnd.choice(TRAPS) + rnd.choice(TRAPS)))
    check(spark, rows, budget=budget, history=history)


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").collect()]
    check(spark, rows)
    check(spark, rows, budget=200, history=60)


def test_odd_rows(spark):
    check(spark, [(1, 0, None, None), (1, 0, None, None), (1, None, "assistant", "first"), (None, 1, "user", "x"),
                  (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"),
                  (3, 0, "assistant", "long " * 30_000), (4, 0, "system", None)])
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], SCHEMA))).count() == 0


def plain_tokens(text):
    return len(re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", text, re.ASCII)) + 4


def test_windows_keep_budget_system_and_history(spark):
    rnd = random.Random(1)
    rows = [(c, t, "system" if t == 0 else ("user", "assistant")[t % 2], "w " * rnd.randint(1, 30))
            for c in range(20) for t in range(25)]
    budget, history = 120, 40
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=budget, history=history)
    pieces = windows.select("*", chat.parse_window(windows["formatted"]).alias("turns")).orderBy(
        "conv_id", "window").collect()
    done = {}
    for w in pieces:
        turns = [(t.role, t.text) for t in w.turns]
        tokens = [plain_tokens(x) for _, x in turns]
        own = [(r[2], r[3]) for r in rows if r[0] == w.conv_id]
        at = done.get(w.conv_id, 0)
        assert turns[0] == own[0]  # the system turn leads every window
        assert sum(tokens) <= budget or w.n_new == 1
        assert len(turns) == w.n_context + w.n_new and turns[w.n_context:] == own[at:at + w.n_new]
        repeated = turns[1:w.n_context] if at else turns[:w.n_context]
        assert repeated == own[at - len(repeated):at]
        assert sum(map(plain_tokens, [x for _, x in repeated])) <= history
        loss = [w.formatted[s.start:s.start + s.length] for s in w.loss]
        assert loss == [x for r, x in turns[w.n_context:] if r == "assistant"]
        done[w.conv_id] = at + w.n_new
    assert set(done.values()) == {25}
    assert any(w.n_context > 1 for w in pieces)


def test_extra_columns_and_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA).selectExpr(
        "*", "1 AS window", "2 AS before", "3 AS tokens", "4 AS formatted", "5 AS loss")
    windows = chat.format_windows(df)
    assert windows.columns == ["conv_id", "window", "n_context", "n_new", "formatted", "loss"]
    assert [r.n_turns for r in chat.read_back(windows).collect()] == [1]
    plan = chat.read_back(windows)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_a_very_long_conversation(spark):
    """Formatting grows with the turns, not with their square; texts meet by window."""
    import time
    from pyspark.sql import functions as F
    took = {}
    for n in (5_000, 40_000):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                     F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                     F.concat(F.lit("turn number "), "id", F.lit(" and a few words")).alias("text"))
        began = time.time()
        windows = chat.format_windows(rows)
        told = windows.agg(F.sum("n_new"), F.max(F.length("formatted")), F.max("n_context")).first()
        took[n] = time.time() - began
        assert told[0] == n and told[1] < 40_000 and told[2] > 0
    assert took[40_000] < 20 * max(1.0, took[5_000])
