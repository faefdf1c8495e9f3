"""Mixing sources to target weights by capped water-filling.

Sources share the mix by weight.  A source is clamped at ``max_epochs`` times
its size; what it cannot take is shared again among the others by weight until
no source is above its clamp.  A source's target becomes whole repetitions of
all its documents plus a seeded sample for the fractional repetition.

Cases: a null text has size 0; a null source is a source of its own; a null
id hashes like an empty one; repeated rows are separate documents; an empty
table gives an empty mix; sources of size 0 get target 0.  Columns of the
input keep their names and values; the added ones are given a leading
underscore where the input already has the name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapseries.llm.common import free_name, global_row_number, id_hash, materialize, word_count

# Bits of the sampling key settled by each pass of the cut search.
DIGIT_BITS = 13
KEY_BITS = 52
SOURCES_PER_FILE = 100_000


def cyclic_weights(sizes: DataFrame, cycle: list[float], source: str = "source") -> DataFrame:
    """Weights ``cycle[0], cycle[1], ...`` repeating over the sources by code point, null last."""
    ranked = global_row_number(sizes, [F.col(source).asc_nulls_last()], "_rank")
    at = F.pmod(F.col("_rank") - 1, F.lit(len(cycle))).cast("int")
    return ranked.withColumn("weight", F.array(*[F.lit(float(x)) for x in cycle])[at]).drop("_rank")


def water_level(sources: DataFrame, total: float) -> float:
    """The level L at which the sum of min(cap, weight * L) is ``total``.

    ``sources`` has ``weight`` and ``cap``.  Each pass clamps the sources whose
    cap lies below their share and spreads the rest again; the level only
    rises, so the passes end.  Only the level is held on the driver.
    """
    level = -1.0
    while True:
        clamped = F.col("cap") < F.col("weight") * F.lit(level)
        r = sources.agg(F.sum(F.when(clamped, F.col("cap"))).alias("taken"),
                        F.sum(F.when(~clamped, F.col("weight"))).alias("weight")).first()
        if not r.weight:
            return float("inf")
        following = (total - (r.taken or 0)) / r.weight
        if following <= level:
            return level
        level = following


def mix_sources(docs: DataFrame, weights, *, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", max_epochs: int = 3, total_share: float = 1.0,
                seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """One row for each document with the words the mix takes of it.

    ``weights`` is a function from the source table (source, source_size) to
    the same with a column ``weight``.  ``keep`` names the input columns to
    carry (default: all).  Added: size, source_size, target (the source's),
    repeats (how often the document is taken) and taken (= size * repeats).
    """
    keep = list(docs.columns) if keep is None else list(keep)
    names = {n: free_name(n, keep) for n in
             ("size", "source_size", "target", "repeats", "taken")}
    # The carried columns travel in one struct, so their names cannot clash.
    rows = materialize(docs.select(
        F.struct(*keep).alias("kept"), F.col(source_col).alias("s"), word_count(text_col).alias("n"),
        id_hash(seed, F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("k1"),
        # Rows that share an id are ordered by their texts; those alike in both may change places.
        F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string")), 64 - KEY_BITS).alias("k2"),
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - KEY_BITS).alias("k3")),
        "mix-rows")
    sizes = rows.groupBy(F.col("s").alias("source")).agg(F.sum("n").alias("source_size"))
    sources = materialize(weights(sizes).withColumn("cap", F.lit(max_epochs) * F.col("source_size")),
                          "mix-sources")
    r = sources.agg(F.sum("source_size").alias("words"), F.count(F.lit(1)).alias("n")).first()
    total, parts = r.words or 0, 1 + r.n // SOURCES_PER_FILE
    level = water_level(sources, total * total_share)
    share = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)) \
        if level != float("inf") else F.col("cap").cast("double")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = (sources.withColumn("target", share).withColumn("whole", whole.cast("long"))
             .withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")))
    cuts = _cut(rows.select("s", "k1", "k2", "k3", "n"), goals, parts)
    joined = rows.join(cuts, rows["s"].eqNullSafe(cuts["source"]))
    key, cut = F.struct("k1", "k2", "k3"), F.struct("c1", "c2", "c3")
    extra = F.coalesce((key < cut) | ((key == cut) & F.col("at_cut")), F.lit(False))
    extra = extra & (F.col("extra") > 0)  # a source at its clamp gives no document once more
    repeats = (F.col("whole") + extra.cast("int")).cast("int")
    return joined.select(
        *[F.col("kept")[c].alias(c) for c in keep], F.col("n").alias(names["size"]),
        F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]),
        repeats.alias(names["repeats"]), (F.col("n") * repeats).alias(names["taken"]))


def _cut(rows: DataFrame, goals: DataFrame, parts: int) -> DataFrame:
    """For each source the key (c1, c2, c3) up to which documents get the extra repetition.

    A radix selection: each pass sums the sizes of the keys that share the
    prefix found so far, by the next digit, and moves into the digit where the
    running sum crosses the goal.  Every pass is a sum that combines on the map
    side, so no source's documents are ever gathered or sorted together.  The
    state, a row for each source, is written to ``parts`` files, so that Spark
    knows its size: it is broadcast where that is small, and documents are
    shuffled by source only where there are very many sources.
    ``at_cut``: the document at the cut is taken if that is nearer the goal.
    """
    zero = F.lit(0).cast("long")
    state = goals.withColumns({"c1": zero, "c2": zero, "c3": zero, "cum": zero})
    passes = [(key, left, max(0, left - DIGIT_BITS)) for key in "123" for left in range(KEY_BITS, 0, -DIGIT_BITS)]
    for n, left, shift in passes:
        key, cut = F.col(f"k{n}"), F.col(f"c{n}")
        state = materialize(state.select(*goals.columns, "c1", "c2", "c3", "cum").repartition(parts), "mix-state")
        near = (rows.join(state.select("source", "c1", "c2", "c3"), rows["s"].eqNullSafe(state["source"]))
                .where(F.shiftright(key, left) == F.shiftright(cut, left)))
        for done in range(1, int(n)):
            near = near.where(F.col(f"k{done}") == F.col(f"c{done}"))
        digit = F.shiftright(key, shift) - F.shiftleft(F.shiftright(key, left), left - shift)
        sums = (near.groupBy("s", digit.alias("d"))
                .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"),
                     F.min(F.struct("k1", "k2", "k3")).alias("key")))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("d"))
        hit = (sums.withColumn("upto", upto)
               .join(state.select("source", "cum", "extra"), F.col("s").eqNullSafe(F.col("source")))
               .where(F.col("cum") + F.col("upto") > F.col("extra"))
               .groupBy("s").agg(F.min(F.struct("d", "n", "upto", "docs", "key")).alias("h")))
        state = materialize(
            state.join(hit, state["source"].eqNullSafe(hit["s"]), "left")
            # No crossing: the goal is all of the source.
            .withColumn(f"c{n}", F.when(F.col("h").isNull(), F.shiftleft(F.lit(1).cast("long"), KEY_BITS))
                        .otherwise(cut + F.shiftleft(F.col("h.d"), shift)))
            .withColumn("cum", F.col("cum") + F.coalesce(F.col("h.upto") - F.col("h.n"), zero))
            .drop("s").repartition(parts), "mix-state")
        if state.where(F.col("h.docs") > 1).isEmpty():
            break
    found = (state.withColumn("at_cut", F.col("cum") + F.col("h.n") / 2 <= F.col("extra"))
             .withColumns({f"c{i}": F.coalesce(F.col(f"h.key.k{i}"), f"c{i}") for i in "123"}).drop("h"))
    return materialize(found.repartition(parts), "mix-cuts")


def expand(mixed: DataFrame, columns: list[str], repeats: str = "repeats") -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    times = F.explode(F.sequence(F.lit(1), F.col(repeats)))
    return mixed.where(F.col(repeats) > 0).select(*columns, times.alias("_copy")).select(*columns)
