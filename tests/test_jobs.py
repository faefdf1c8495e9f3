"""The four batch jobs end to end on the smallest driver tables."""

import os

from gapseries.plans import jobs
from gapseries.sources import testdata as td
from tests.conftest import SF001


def test_jobs_write_and_chain(spark, tmpdir_path):
    sf = SF001
    m = jobs.matrix_job(td.brand_events(spark, sf), td.brand_items(spark, sf),
                        td.diagnoses(spark, sf), tmpdir_path, entity="entity", item="item",
                        item_code="item_code", category="category", min_support=1)
    assert spark.read.parquet(m["items_limit"] + ".parquet").count() > 0
    assert "sum" in spark.read.parquet(m["code_item_matrix"] + ".parquet").columns

    c = jobs.cohort_job(td.events(spark, sf), td.event_items(spark, sf), td.diagnoses(spark, sf),
                        tmpdir_path, roles=td.ROLES, item_codes="CLICK", code1="1F", code2="2O")
    series = spark.read.parquet(c["series"] + ".parquet")
    assert {r.split for r in series.select("split").distinct().collect()} <= {"train", "test"}
    assert os.path.isdir(c["categories"] + ".csv")

    hp = jobs.hyperparameter_job(spark, c["series"] + ".parquet",
                                 os.path.join(tmpdir_path, "hp"), roles=td.ROLES, item_code="CLICK",
                                 sigma2=(0.05, 0.2, 0.15), alpha=(1.0, 2.0, 1.0), tau=(0.5, 1.0, 0.5))
    pred_path = jobs.resample_job(spark, c["series"] + ".parquet", hp,
                                  os.path.join(tmpdir_path, "pred"), roles=td.ROLES,
                                  item_code="CLICK", csv=True)
    assert spark.read.option("header", True).csv(pred_path + ".csv").count() == \
        spark.read.parquet(pred_path).count()
    assert spark.read.option("header", True).csv(c["series"] + ".csv").count() == series.count()
    pred = spark.read.parquet(pred_path)
    assert pred.count() > 0 and {"mean", "variance", "t_warped", "split"} <= set(pred.columns)
