"""The jobs on tables with the declared clinical schemas (default Roles)."""

import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from gapseries import Roles
from gapseries.functions import code_category
from gapseries.plans import jobs
from gapseries.schemas import D_LABITEMS, DIAGNOSES_ICD, LABEVENTS


def test_quick_start_flow(spark, tmpdir_path):
    rng = np.random.default_rng(0)
    base = dt.datetime(2101, 1, 1)
    lab, rid = [], 0
    for adm in range(1, 13):
        for k in range(int(rng.integers(3, 9))):
            rid += 1
            t = base + dt.timedelta(hours=float(rng.uniform(0, 200)))
            lab.append((rid, 100 + adm, adm, 50912, t, "x", float(rng.normal(1.0, 0.3)),
                        "mg/dL" if k % 4 else None, None))
        rid += 1
        lab.append((rid, 100 + adm, adm, 51000, base, "y", 2.0, "u", None))
    labevents = spark.createDataFrame(lab, LABEVENTS)
    items = spark.createDataFrame([(1, 50912, "Creatinine", "Blood", "Chemistry", "2160-0"),
                                   (2, 51000, "Other", "Blood", "Chemistry", "9999-9")], D_LABITEMS)
    diag_rows = [(i, 100 + a, a, 1, "4280" if a % 2 else "5715") for i, a in enumerate(range(1, 13))]
    diag_rows.append((99, 101, 1, 2, "4281"))
    diag = spark.createDataFrame(diag_rows, DIAGNOSES_ICD).withColumn(
        "ICD9_CATEGORY", code_category("ICD9_CODE", 3))
    roles = Roles()
    c = jobs.cohort_job(labevents, items, diag, tmpdir_path, roles=roles, item_codes="2160-0",
                        code1="428", code2="571", item_code="LOINC_CODE",
                        diag_category="ICD9_CATEGORY", balance="hash")
    series = spark.read.parquet(c["series"] + ".parquet")
    per_class = {r.ICD9_CATEGORY: r.n for r in
                 series.select("HADM_ID", "VALUEUOM", "ICD9_CATEGORY").distinct()
                 .groupBy("ICD9_CATEGORY").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(per_class) == {"428", "571"} and len(set(per_class.values())) == 1
    assert series.where(F.col("ITEMID") != 50912).count() == 0
    hp = jobs.hyperparameter_job(spark, c["series"] + ".parquet", os.path.join(tmpdir_path, "hp"),
                                 roles=roles, item_code="2160-0", sigma2=(0.05, 0.2, 0.15),
                                 alpha=(1.0, 2.0, 1.0), tau=(0.5, 1.0, 0.5))
    pred = spark.read.parquet(jobs.resample_job(spark, c["series"] + ".parquet", hp,
                                                os.path.join(tmpdir_path, "pred"), roles=roles))
    assert pred.count() > 0 and {"HADM_ID", "SUBJECT_ID", "mean", "variance"} <= set(pred.columns)
