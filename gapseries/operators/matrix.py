"""Code x item co-occurrence matrix operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_items(support: DataFrame, dim: DataFrame, item: str, k: int = 100,
              count: str = "count") -> DataFrame:
    """The ``k`` best-supported items, joined to the item dimension.

    Ties on the count are broken by item, ascending.  The join comes after the
    limit, so items missing from the dimension shrink the result.
    """
    top = support.orderBy(F.col(count).desc(), F.col(item).asc()).limit(k)
    dim_cols = [c for c in dim.columns if c != item]
    return dim.join(top, item, "inner").select(item, count, *dim_cols)


def cooccurrence_cells(top: DataFrame, pairs: DataFrame, diagnoses: DataFrame,
                       entity: str, item: str, item_code: str, category: str) -> DataFrame:
    """Long-form matrix: (category, item_code, n).

    n counts (top item, entity, diagnosis row) triples, so an entity with two
    rows of a category counts twice and items sharing a code add up.  Both
    sides are reduced to per-entity counts before the entity join, so a hot
    entity contributes (items x categories) rows, not the product of its rows.
    """
    codes = top.where(F.col(item_code).isNotNull()).select(item, item_code)
    per_entity_code = (pairs.where(F.col(entity).isNotNull())
                       .join(codes, item, "inner")
                       .groupBy(entity, item_code).agg(F.count(F.lit(1)).alias("_ni")))
    per_entity_cat = (diagnoses.where(F.col(entity).isNotNull())
                      .groupBy(entity, category).agg(F.count(F.lit(1)).alias("_nd")))
    return (per_entity_code.join(per_entity_cat, entity, "inner")
            .groupBy(category, item_code)
            .agg(F.sum(F.col("_ni") * F.col("_nd")).cast("bigint").alias("n")))


def pivot_matrix(cells: DataFrame, category: str, item_code: str, codes: list[str],
                 k: int | None = 125, total: str = "sum") -> DataFrame:
    """Wide matrix: one column per code (0 where absent), row ``total``,
    the ``k`` largest rows (ties by category)."""
    clash = {category.lower(), total.lower()} & {c.lower() for c in codes}
    if clash:
        raise ValueError(f"an item code has the name of another column: {sorted(clash)}")
    wide = cells.groupBy(category).pivot(item_code, codes).agg(F.first("n"))
    # Codes may hold dots and other marks, so every reference is quoted.
    counts = {c: F.coalesce(F.col("`" + c.replace("`", "``") + "`"), F.lit(0).cast("bigint")) for c in codes}
    row_total = reduce(lambda a, b: a + b, counts.values(), F.lit(0).cast("bigint"))
    out = (wide.select(category, *[x.alias(c) for c, x in counts.items()], row_total.alias(total))
           .orderBy(F.col(total).desc(), F.col(category).asc()))
    return out.limit(k) if k is not None else out
