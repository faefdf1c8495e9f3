"""Cohort operators on the hand-written fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gapseries.operators import cohort as co
from gapseries.plans.cohort import build_cohort
from gapseries.roles import Roles


def test_exclusive_cohort_keeps_entities_with_one_code(spark):
    rows = [(1, "4280"), (1, "4281"), (2, "5715"), (3, "4280"), (3, "5715"), (4, None),
            (5, "99999")]
    diag = spark.createDataFrame(rows, "entity int, code string").withColumn(
        "category", F.substring("code", 1, 3))
    got = co.exclusive_cohort(diag, "entity", "category", "428", "571")
    assert sorted((r.entity, r.num_code1, r.num_code2) for r in got.collect()) == [
        (1, 2, 0), (2, 0, 1)]
    labels = co.cohort_labels(got, "entity", "428", "571", out="category")
    assert sorted(tuple(r) for r in labels.collect()) == [(1, "428"), (2, "571")]


def test_same_code_twice_raises(spark):
    diag = spark.createDataFrame([(1, "428")], "entity int, category string")
    with pytest.raises(ValueError):
        co.exclusive_cohort(diag, "entity", "category", "428", "428")


def test_min_length_pairs_counts_rows_and_null_entities(spark):
    rows = [(1, 10)] * 2 + [(2, 10)] * 3 + [(3, 10)] * 4 + [(None, 10)] * 5
    ev = spark.createDataFrame(rows, "entity int, item int")
    pairs = co.min_length_pairs(ev, "entity", "item", 3)
    assert sorted((r.entity is None, r.entity) for r in pairs.collect()) == [
        (False, 2), (False, 3), (True, None)]
    kept = co.min_length_events(ev, "entity", "item", 3)
    assert kept.count() == 7  # the null entity counts as a pair but never joins


def test_item_support_and_supported_pairs(spark):
    pairs = spark.createDataFrame([(e, 1) for e in range(30)] + [(e, 2) for e in range(29)]
                                  + [(None, 1)], "entity int, item int")
    sup = co.item_support(pairs, "item", 30)
    assert [(r.item, r["count"]) for r in sup.collect()] == [(1, 31)]
    good = co.supported_pairs(pairs, sup, "entity", "item")
    assert good.count() == 30


def _ts(day, hour=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_build_cohort_null_time_value_and_mixed_units(spark):
    roles = Roles(entity="adm", item="item", time="t", value="v", subject=None, unit="uom",
                  tie="rid", category="cat")
    ev = [(1, 7, _ts(0), 1.0, "mg", 1), (1, 7, _ts(1), 2.0, "mg", 2), (1, 7, _ts(2), 3.0, "g", 3),
          (1, 7, None, 4.0, "mg", 4), (1, 7, _ts(4), None, "mg", 5),
          (2, 7, _ts(0), 1.0, None, 6), (2, 7, _ts(1), 1.0, None, 7)]
    events = spark.createDataFrame(ev, "adm int, item int, t timestamp, v double, uom string, rid int")
    items = spark.createDataFrame([(7, "X")], "item int, item_code string")
    diag = spark.createDataFrame([(1, "AA"), (2, "BB")], "adm int, category string")
    out = build_cohort(events, items, diag, roles=roles, item_codes="X", code1="AA", code2="BB")
    got = sorted((r.adm, r.uom, r.t_rel, r.v) for r in out.collect())
    # entity 2 has only 2 rows -> dropped; null time and null value rows of entity 1
    # still count towards its length, then are dropped; units split the series
    assert got == [(1, "g", 0.0, 3.0), (1, "mg", 0.0, 1.0), (1, "mg", 1.0, 2.0)]
    out0 = build_cohort(events, items, diag, roles=roles, item_codes="X", code1="AA",
                        code2="BB", null_values="zero")
    assert sorted(r.v for r in out0.collect()) == [0.0, 1.0, 2.0, 3.0]


def test_select_item_events(spark):
    events = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 13), (5, None)], "entity int, item int")
    dim = spark.createDataFrame([(10, "A"), (11, "A"), (12, "B"), (13, None), (10, "B")],
                                "item int, item_code string")

    def chosen(codes):
        df = co.select_item_events(events, dim, "item", "item_code", codes)
        return sorted(tuple(r) for r in df.select("entity", "item", "item_code").collect())
    assert chosen("A") == [(1, 10, "A"), (2, 11, "A")]
    # an item listed under two of the codes gives its events once for each
    assert chosen(["A", "B"]) == [(1, 10, "A"), (1, 10, "B"), (2, 11, "A"), (3, 12, "B")]
    assert chosen("ZZZ") == []


def test_series_with_a_null_subject_stays(spark):
    roles = Roles(entity="adm", item="item", time="t", value="v", subject="sub", unit=None, tie="rid", category="cat")
    ev = [(1, 7, s, _ts(i), 1.0, i) for i, s in enumerate([5, None, 5, None, None])]
    events = spark.createDataFrame(ev, "adm int, item int, sub int, t timestamp, v double, rid int")
    items = spark.createDataFrame([(7, "X")], "item int, item_code string")
    diag = spark.createDataFrame([(1, "AA")], "adm int, category string")
    out = build_cohort(events, items, diag, roles=roles, item_codes="X", code1="AA", code2="BB")
    assert sorted((r.sub or 0, r.rid) for r in out.collect()) == [(0, 1), (0, 3), (0, 4), (5, 0), (5, 2)]


def test_length_test_on_the_full_series_key(spark):
    roles = Roles(entity="adm", item="item", time="t", value="v", subject=None, unit="uom",
                  tie="rid", category="cat")
    ev = [(1, 7, _ts(0), 1.0, "mg", 1), (1, 7, _ts(1), 2.0, "mg", 2), (1, 7, _ts(2), 3.0, "g", 3),
          (1, 7, _ts(3), 4.0, "mg", 4)]
    events = spark.createDataFrame(ev, "adm int, item int, t timestamp, v double, uom string, rid int")
    items = spark.createDataFrame([(7, "X")], "item int, item_code string")
    diag = spark.createDataFrame([(1, "AA")], "adm int, category string")
    kw = dict(roles=roles, item_codes="X", code1="AA", code2="BB")
    pair = build_cohort(events, items, diag, **kw)
    full = build_cohort(events, items, diag, length_key="series", **kw)
    assert sorted(r.rid for r in pair.collect()) == [1, 2, 3, 4]   # the pair has 4 rows
    assert sorted(r.rid for r in full.collect()) == [1, 2, 4]      # the 'g' series has 1
