"""Plan properties that matter at scale (checked on sf0.001 plans)."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry
from gapseries import queries as core
from tests.conftest import SF001

PYTHON_OK = {"gp_log_likelihood", "gp_resample", "gp_grid_search", "gp_hyperparameters",
             "gp_grid_search_coarse", "gp_hyperparameters_coarse", "extract_patches", "uncertainty_band",
             "series_overlay", "encode_patches_rule", "encode_patches_rule_2", "feature_scaler",
             "gp_log_likelihood_se", "gp_grid_search_se", "csv_predictions", "encode_saved_weights",
             "cut_drawn_patches", "overlay_missing", "extract_patches_chunks",
             "gp_log_likelihood_tiled", "gp_resample_tiled"}
# Queries that train a model while they are built.
TRAINS = {"phenotype_features"}
# The queries of the library's core: without those that other modules add.
CORE = sorted(core.QUERIES)


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", CORE)
def test_no_cartesian_and_python_only_where_needed(spark, name):
    if name in TRAINS:
        pytest.skip("trains a model while building; covered by the rows-only smoke test")
    plan = plan_of(entry.queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Every window is partitioned: none makes one task see all rows.
    for window in re.findall(r"\) Window\b[^\n]*\nInput[^\n]*\nArguments: ([^\n]*)", plan):
        assert len(window.split("], [")) >= 3, window
    if name not in PYTHON_OK:
        assert not re.search(r"MapInPandas|ArrowEvalPython|BatchEvalPython", plan), name


def test_item_filter_reaches_the_dimension_scan(spark):
    plan = plan_of(entry.queries()["cohort_series"](spark, SF001))
    assert "upper(event_type" in plan and "= CLICK)" in plan


def test_cohort_shuffles_points_once(spark):
    plan = plan_of(entry.queries()["cohort_series_all_items"](spark, SF001))
    # points go out once, by series and time block; the rest is summaries
    shuffles = re.findall(r"Arguments: hashpartitioning\(([^)]*)\), REPARTITION", plan)
    assert len(set(re.sub(r"#\d+L?", "", s) for s in shuffles)) == 1, shuffles


@pytest.mark.parametrize("name", [n for n in CORE if n in PYTHON_OK])
def test_the_gp_runs_once(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF001))
    details = plan.split("\n\n(1)", 1)[-1]
    assert len(re.findall(r"\) MapInPandas", details)) <= 1


def test_sampled_patches_are_written_before_they_are_read_twice(spark):
    """The scaler's moments and its rows share one run of the GP, extents and GP one cohort."""
    plan = plan_of(entry.queries()["feature_scaler"](spark, SF001))
    assert "MapInPandas" not in plan and "Scan parquet" not in plan
    assert "Scan parquet" not in plan_of(entry.queries()["encode_patches_rule"](spark, SF001))


@pytest.mark.parametrize("name", ["patch_counts", "sample_patches", "validation_split"])
def test_choosing_patches_runs_no_gp(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF001))
    assert "Python" not in plan and "Pandas" not in plan


def test_grid_search_shuffles_only_partial_sums(spark):
    plan = plan_of(entry.queries()["gp_grid_search"](spark, SF001))
    # one Python stage; the shuffle after it is keyed by the (alpha, tau) pair
    details = plan.split("\n\n(1)", 1)[1]
    udf_at = details.index("MapInPandas")
    assert re.search(r"hashpartitioning\(alpha#\d+, tau#\d+", details[udf_at:])
    assert len(re.findall(r"\) MapInPandas", details)) == 1
