"""Q1: code x item co-occurrence matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gapseries.operators.cohort import item_support, min_length_pairs
from gapseries.operators.matrix import cooccurrence_cells, pivot_matrix, top_items
from gapseries.session import cut_lineage


def code_item_matrix(events: DataFrame, items: DataFrame, diagnoses: DataFrame, *,
                     entity: str, item: str, item_code: str, category: str,
                     min_length: int = 3, min_support: int = 30,
                     n_items: int = 100, n_categories: int = 125,
                     wide: bool = True, codes: list[str] | None = None) -> DataFrame:
    """How often the top diagnosis categories co-occur with the top items.

    Steps: pairs with >= ``min_length`` rows; items in >= ``min_support``
    pairs; the ``n_items`` best supported items joined to their dimension;
    (item, entity, diagnosis row) triples counted per (category, item code);
    pivoted wide, a row total ``sum``, the ``n_categories`` largest rows.
    With ``wide=False`` the long cells (category, item_code, n) are returned.
    ``codes`` names the columns of the wide form (default: the codes of the top
    items, at most ``n_items``); other codes are left out of it and its total.
    """
    # The pairs are read for the support and again for the cells: write the
    # aggregate once, so the large event join is not evaluated twice.
    pairs = cut_lineage(min_length_pairs(events, entity, item, min_length))
    support = item_support(pairs, item, min_support)
    top = top_items(support, items, item, n_items)
    # The top items are a subset of the supported ones, so joining the pairs
    # with the top items already keeps only supported pairs: the
    # separate semi join with the support table would be a redundant shuffle.
    cells = cooccurrence_cells(top, pairs, diagnoses, entity, item, item_code, category)
    if not wide:
        return cells
    if codes is None:
        # The pivot values are the top items' codes: at most n_items of them.
        codes = sorted(r[0] for r in top.where(top[item_code].isNotNull())
                       .select(item_code).distinct().collect())
    return pivot_matrix(cells, category, item_code, codes, n_categories)
