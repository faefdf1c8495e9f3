"""Small plan helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (list, tuple)):
        return list(x)
    return [x]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where null equals null (key columns kept from ``left``)."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


# Task vectors the driver sums by itself; more are first summed by tasks.
DRIVER_VECTORS = 64
VECTOR = T.StructType([T.StructField("slot", T.LongType()), T.StructField("g", T.ArrayType(T.DoubleType()))])


def sum_vectors(vectors: DataFrame, slots: int | None = None) -> np.ndarray | None:
    """Sum of the array column ``g`` over all rows (slot, g), None without rows.

    Rows are added in the order of their slot (a number below ``slots``; by
    default the number of partitions), in two levels if there are many, so the
    driver receives few vectors and the sum does not depend on the layout.
    """
    slots = slots or vectors.rdd.getNumPartitions()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, total = None, None
        for b in batches:
            for slot, g in zip(b["slot"].values, b["g"].values):
                if slot // width != group:
                    if total is not None:
                        yield pd.DataFrame({"slot": [group], "g": [total]})
                    group, total = slot // width, np.array(g)
                else:
                    total = total + g
        if total is not None:
            yield pd.DataFrame({"slot": [group], "g": [total]})

    if slots > DRIVER_VECTORS:
        width = int(np.ceil(np.sqrt(slots)))
        group = F.floor(F.col("slot") / F.lit(width))
        vectors = (vectors.repartition(width, group).sortWithinPartitions("slot")
                   .mapInPandas(add, VECTOR))
    rows = sorted(vectors.collect(), key=lambda r: r["slot"])
    return sum(np.array(r["g"]) for r in rows) if rows else None
