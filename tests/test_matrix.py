"""Code x item matrix: fan-out, shared codes, missing dimension rows, ties."""

import pytest

from gapseries.operators import matrix as mx
from gapseries.plans.matrix import code_item_matrix


def _run(spark, events, dim, diag, **kw):
    ev = spark.createDataFrame(events, "entity int, item int")
    d = spark.createDataFrame(dim, "item int, item_code string")
    dg = spark.createDataFrame(diag, "entity int, category string")
    return code_item_matrix(ev, d, dg, entity="entity", item="item", item_code="item_code",
                            category="category", min_length=1, min_support=1, **kw)


def test_fan_out_counts_each_diagnosis_row(spark):
    m = _run(spark, [(1, 10)], [(10, "A")], [(1, "428"), (1, "428")]).collect()
    assert [(r.category, r.A, r["sum"]) for r in m] == [("428", 2, 2)]


def test_two_items_sharing_a_code_add_up(spark):
    m = _run(spark, [(1, 10), (1, 11)], [(10, "A"), (11, "A")], [(1, "428")]).collect()
    assert [(r.category, r.A, r["sum"]) for r in m] == [("428", 2, 2)]


def test_item_missing_from_dimension_shrinks_top_k(spark):
    sup = spark.createDataFrame([(10, 5), (11, 4), (12, 3)], "item int, count long")
    dim = spark.createDataFrame([(10, "A"), (12, "C")], "item int, item_code string")
    top = mx.top_items(sup, dim, "item", k=2).collect()
    assert [(r.item, r["count"]) for r in top] == [(10, 5)]


def test_top_items_ties_by_item(spark):
    sup = spark.createDataFrame([(12, 5), (10, 5), (11, 5)], "item int, count long")
    dim = spark.createDataFrame([(i, str(i)) for i in (10, 11, 12)], "item int, item_code string")
    top = mx.top_items(sup, dim, "item", k=2).orderBy("item").collect()
    assert [r.item for r in top] == [10, 11]


def test_matrix_rows_ordered_and_limited(spark):
    events = [(e, 10) for e in range(4)] + [(e, 11) for e in range(2)]
    diag = [(0, "X"), (1, "X"), (2, "Y"), (3, "Z"), (0, "Z")]
    m = _run(spark, events, [(10, "A"), (11, "B")], diag, n_categories=2).collect()
    assert [(r.category, r.A, r.B, r["sum"]) for r in m] == [("X", 2, 2, 4), ("Z", 2, 1, 3)]


def test_codes_with_dots_and_given_codes(spark):
    args = [(1, 10), (1, 11)], [(10, "a.b"), (11, "c`d")], [(1, "428")]
    m = _run(spark, *args)
    assert m.columns == ["category", "a.b", "c`d", "sum"]
    assert [tuple(r) for r in m.collect()] == [("428", 1, 1, 2)]
    m = _run(spark, *args, codes=["a.b", "none"])
    assert [tuple(r) for r in m.collect()] == [("428", 1, 0, 1)]


def test_code_named_like_another_column(spark):
    with pytest.raises(ValueError, match="sum"):
        _run(spark, [(1, 10)], [(10, "SUM")], [(1, "428")])
