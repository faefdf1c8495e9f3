"""Chat formatting into budgeted, turn-aligned windows.

A conversation's turns are laid out by a template; prefix sums of the turns'
tokens choose spans of whole turns that fit the budget.  Every window opens
with the system turn and repeats some of the history before its new turns;
only new assistant texts are targets, so each is learned from once.

Cases: a null text is empty and a null role is an empty role; turns with the
same number are ordered by role and text, null numbers come first; a turn
longer than the budget fills a window of its own; an empty table gives no
rows.  Formatting gathers a conversation's token counts only (a few bytes a
turn); texts meet by window.  The digests of :func:`read_back` need a whole
conversation in one row, which Spark bounds at 2 GB.  Only columns and SQL
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapseries.llm.common import materialize

# The template: "### Role: text </turn>\n" around escaped text.
OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
END_MARK, OPEN_MARK = "</turn>", "###"
# Control strings and what stands for them inside a text.
ESCAPES = {"\\": "\\\\", END_MARK: "\\e", OPEN_MARK: "\\h"}
COLON = "\\c"  # for ":" inside a role


def escape(text: Column) -> Column:
    """Replace control strings, so that none is left inside a text."""
    for control, code in ESCAPES.items():
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Undo :func:`escape`: cut at escaped backslashes, restore the marks between them."""
    def restore(part: Column) -> Column:
        for mark, code in ((END_MARK, "\\e"), (OPEN_MARK, "\\h"), (":", COLON)):
            part = F.replace(part, F.lit(code), F.lit(mark))
        return part
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), restore), "\\")


TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]"
TEMPLATE_TOKENS = 4


def token_count(text: Column) -> Column:
    """ASCII words and other visible characters of a text, and those of the template."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN)) + F.lit(TEMPLATE_TOKENS)


def _starts(tokens: Column, room: Column) -> Column:
    """Turns (from 0) at which windows begin and the tokens before them, packing whole turns into ``room``."""
    def step(state: Column, n: Column) -> Column:
        used = state["used"] + n
        fits = (F.size(state["starts"]) > 0) & (used <= room)
        one = F.struct(state["at"].alias("start"), state["sum"].alias("start_before"))
        return F.struct(
            F.when(fits, state["starts"]).otherwise(F.array_append(state["starts"], one)).alias("starts"),
            F.when(fits, used).otherwise(n).alias("used"), (state["sum"] + n).alias("sum"),
            (state["at"] + F.lit(1)).alias("at"))
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<struct<start:int,start_before:bigint>>")
    empty = F.struct(none.alias("starts"), zero.alias("used"), zero.alias("sum"), F.lit(0).alias("at"))
    return F.aggregate(tokens, empty, step, lambda s: s["starts"])


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """(c, i, window, context): the turns of each window, whether new or repeated; no texts."""
    # The room is made of plain columns: an expression over the array would be evaluated for every turn.
    per = turns.groupBy("_conv").agg(
        F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("_turns"), F.max("system").alias("system"),
        F.count(F.lit(1)).cast("int").alias("n"), F.min_by("tokens", "at").alias("first_tokens"))
    room = F.greatest(F.lit(budget) - F.lit(history) - F.col("system") * F.col("first_tokens"), F.lit(1))
    starts = per.select("_conv", "system", "n", _starts(F.transform("_turns", lambda t: t["tokens"]), room).alias("_starts"))
    windows = starts.select("_conv", "system", "n", "_starts", F.posexplode("_starts").alias("window", "_s")).select(
        F.col("_conv").alias("c"), "system", "window", "_s.start", "_s.start_before",
        F.coalesce(F.get("_starts", F.col("window") + 1)["start"], F.col("n")).alias("after"))
    parts = [windows.select("c", F.explode(F.sequence("start", F.col("after") - 1)).alias("i"), "window",
                            F.lit(False).alias("context")),
             windows.where("window > 0 AND system = 1").select("c", F.lit(0).alias("i"), "window",
                                                               F.lit(True).alias("context"))]
    if history > 0:
        # The turns at most ``history`` tokens before a start lie in two stretches of so many tokens.
        stretch = F.expr(f"start_before div {history}")
        near = windows.where("window > 0").select("c", "system", "window", "start", "start_before",
                                                  F.explode(F.array(stretch - 1, stretch)).alias("stretch"))
        earlier = turns.select("_conv", F.col("at").alias("i"), "before",
                               F.expr(f"before div {history}").alias("lies"))
        met = near.join(earlier, (F.col("c") == F.col("_conv")) & (F.col("stretch") == F.col("lies")))
        parts.append(met.where((F.col("i") < F.col("start")) & (F.col("i") >= F.col("system"))
                               & (F.col("start_before") - F.col("before") <= F.lit(history)))
                     .select("c", "i", "window", F.lit(True).alias("context")))
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    return placed


def format_windows(conversations: DataFrame, *, budget: int = 2048, history: int = 512,
                   conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each window: the formatted text and the spans under the loss mask.

    Columns: conv_col, window (from 0), n_context (leading turns that repeat
    earlier ones: the system turn and history), n_new, formatted, loss (array of
    code point spans ``start``, ``length`` in ``formatted``).
    ``budget`` bounds a window's tokens, of which up to ``history`` repeat
    turns just before the window; the system turn is the first turn if its role
    is ``system``, and is part of the budget.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    # Structs compare null fields as equal, so a null conversation is one like any other.
    rows = conversations.select(F.struct(F.col(conv_col)).alias("_conv"), F.col(turn_col).alias("_turn"),
                                role.alias("role"), text.alias("text"),
                                token_count(text).cast("long").alias("tokens"))
    w = Window.partitionBy("_conv").orderBy("_turn", "role", "text")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Written once: windows are placed from its narrow columns alone.
    turns = materialize(rows.select(
        "_conv", "role", "text", "tokens", (F.sum("tokens").over(upto) - F.col("tokens")).alias("before"),
        (F.row_number().over(w) - 1).alias("at"),
        (F.first("role").over(upto) == F.lit("system")).cast("int").alias("system")), "chat-turns")
    placed = _placed(turns, budget, history)
    said = turns.select("_conv", "at", "role", "text").join(
        placed, (F.col("_conv") == F.col("c")) & (F.col("at") == F.col("i")))
    windows = (said.groupBy("_conv", "window")
               .agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("_said"),
                    F.count_if("context").cast("int").alias("n_context"))
               .withColumn("n_new", F.size("_said") - F.col("n_context")))

    def laid(t: Column) -> Column:
        role = F.replace(escape(t["role"]), F.lit(":"), F.lit(COLON))
        return F.struct(F.concat(F.lit(OPEN), role, F.lit(SEP)).alias("head"),
                        escape(t["text"]).alias("body"), t["role"].alias("role"))

    windows = windows.select(F.col(f"_conv.`{conv_col}`").alias(conv_col), "window", "n_context", "n_new",
                             F.transform("_said", laid).alias("_laid"))

    def span(state: Column, t: Column) -> Column:
        start = state["at"] + F.char_length(t["head"])
        target = t["role"].isin(*loss_roles) & (state["i"] >= F.col("n_context"))
        one = F.struct(start.alias("start"), F.char_length(t["body"]).alias("length"))
        return F.struct(
            (start + F.char_length(t["body"]) + F.lit(len(CLOSE))).alias("at"),
            (state["i"] + F.lit(1)).alias("i"),
            F.when(target, F.array_append(state["spans"], one)).otherwise(state["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"),
                    F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    text = F.array_join(F.transform("_laid", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return windows.select(conv_col, "window", "n_context", "n_new", text.alias("formatted"),
                          F.aggregate("_laid", zero, span, lambda s: s["spans"]).alias("loss"))


def parse_window(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window, unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != F.lit(""))

    def one(p: Column) -> Column:
        at = F.locate(SEP, p, len(OPEN) + 1)
        return F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))).alias("role"),
                        unescape(F.substring(p, at + F.lit(len(SEP)), F.char_length(p))).alias("text"))
    return F.transform(pieces, one)


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted windows hold, by conversation: turns, loss text and sizes."""
    turns = F.slice(parse_window(F.col("formatted")), F.col("n_context") + 1, F.col("n_new"))
    loss = F.transform("loss", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + F.lit(1), s["length"])))
    per = (windows.select(conv_col, "window", F.char_length("formatted").alias("_chars"),
                          turns.alias("_turns"), F.array_join(loss, "").alias("_loss"))
           .groupBy(conv_col)
           .agg(F.array_sort(F.collect_list(F.struct("window", "_turns", "_loss"))).alias("_w"),
                F.sum("_chars").cast("long").alias("formatted_chars")))
    said = F.flatten(F.transform("_w", lambda w: w["_turns"]))
    lines = F.transform("_said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (per.select(conv_col, "formatted_chars", said.alias("_said"),
                       F.array_join(F.transform("_w", lambda w: w["_loss"]), "").alias("_loss"))
            .select(conv_col, F.size("_said").cast("long").alias("n_turns"),
                    F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("turns_sha256"),
                    F.char_length("_loss").cast("long").alias("loss_chars"),
                    F.sha2(F.encode("_loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars"))
