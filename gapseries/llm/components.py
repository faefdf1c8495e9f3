"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapseries.llm.common import materialize

JUMPS = 2


def connected_components(edges: DataFrame, seed: int = 42) -> DataFrame:
    """(node, root) for every node of the edges (a, b); roots are equal within a component.

    Each round every node points to its neighbour of least priority (itself
    included), pointers are followed a few steps, and the edges are rewritten
    to what their ends point to; edges inside a node vanish.  Priorities are
    hashes, so chains stay short whatever the ids, and the edges shrink by a
    factor each round.  Tables are written between rounds; nothing but an
    emptiness test reaches the driver.
    """
    edges = materialize(edges.select("a", "b"), "edges")
    labels = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
                         .withColumn("root", F.col("node")), "labels")
    rounds = 0
    while not edges.isEmpty():
        rounds += 1
        near = edges.union(edges.select("b", "a"))

        def rank(c):
            return F.struct(F.xxhash64(F.lit(seed + rounds), F.col(c)).alias("h"), F.col(c).alias("n"))
        points = near.groupBy("a").agg(F.min(rank("b")).alias("m"))
        to = F.when(F.col("m") < rank("a"), F.col("m.n")).otherwise(F.col("a"))
        points = materialize(points.select(F.col("a").alias("u"), to.alias("p")), "pointers")
        for _ in range(JUMPS):
            step = points.select(F.col("u").alias("v"), F.col("p").alias("q"))
            points = materialize(points.join(step, F.col("p") == F.col("v")).select(
                "u", F.col("q").alias("p")), "pointers")
        pa_, pb = (points.select(F.col("u").alias(f"u{c}"), F.col("p").alias(f"p{c}")) for c in "ab")
        edges = materialize(
            edges.join(pa_, F.col("a") == F.col("ua")).join(pb, F.col("b") == F.col("ub"))
            .where(F.col("pa") != F.col("pb"))
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        labels = materialize(
            labels.join(points, F.col("root") == F.col("u"), "left")
            .select("node", F.coalesce("p", "root").alias("root")), "labels")
    return labels
