"""The four batch jobs, writing their tables to an output folder.

| job                      | writes (under ``out_dir``)                                   |
| ------------------------ | ------------------------------------------------------------ |
| :func:`matrix_job`       | ``items_limit`` (top items + dimension), ``code_item_matrix`` |
| :func:`cohort_job`       | ``<tag>_diag``, ``<tag>_categories``, ``<tag>_series`` (long form, partitioned by split) |
| :func:`hyperparameter_job` | the best grid point for the item code (one row, CSV, at ``out_path``) |
| :func:`resample_job`     | GP predictions (long form, partitioned by split, at ``out_path``) |

Each table is written once, as Parquet and, where it is small or meant for
other tools, also as CSV part files (one per task; nothing funnels through a
single task).  Jobs read what the previous job wrote, so they can run in
separate sessions.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapseries.operators.cohort import (cohort_labels, exclusive_cohort, item_support,
                                        min_length_pairs)
from gapseries.operators.matrix import cooccurrence_cells, pivot_matrix, top_items
from gapseries.plans.cohort import build_cohort
from gapseries.plans.gp import optimize_hyperparameters, resample_cohort
from gapseries.roles import Roles
from gapseries.session import cut_lineage
from gapseries.sources.io import (load_hyperparams, load_series, save_hyperparams, save_series,
                                  save_table)


def cohort_tag(code1: str, code2: str, item_codes: str | Sequence[str]) -> str:
    codes = [item_codes] if isinstance(item_codes, str) else list(item_codes)
    return "cohort_" + "_".join([code1, code2] + codes)


def matrix_job(events: DataFrame, items: DataFrame, diagnoses: DataFrame, out_dir: str, *,
               entity: str, item: str, item_code: str, category: str,
               min_length: int = 3, min_support: int = 30, n_items: int = 100,
               n_categories: int = 125, csv: bool = True) -> dict[str, str]:
    """Top items and the code x item matrix (see ``plans.matrix``)."""
    pairs = cut_lineage(min_length_pairs(events, entity, item, min_length))
    support = item_support(pairs, item, min_support)
    top = cut_lineage(top_items(support, items, item, n_items))
    cells = cooccurrence_cells(top, pairs, diagnoses, entity, item, item_code, category)
    # The names of the stored tables are fixed by the jobs that read them.
    codes = sorted(r[0] for r in top.where(F.col(item_code).isNotNull())
                   .select(item_code).distinct().collect())
    matrix = pivot_matrix(cells, category, item_code, codes, n_categories)
    paths = {"items_limit": os.path.join(out_dir, "items_limit"),
             "code_item_matrix": os.path.join(out_dir, "code_item_matrix")}
    save_table(top, paths["items_limit"] + ".parquet")
    save_table(matrix, paths["code_item_matrix"] + ".parquet")
    if csv:
        save_table(top, paths["items_limit"] + ".csv", "csv")
        save_table(matrix, paths["code_item_matrix"] + ".csv", "csv")
    return paths


def cohort_job(events: DataFrame, items: DataFrame, diagnoses: DataFrame, out_dir: str, *,
               roles: Roles, item_codes: str | Sequence[str], code1: str, code2: str,
               diag_category: str = "category", csv: bool = True, **cohort_kw) -> dict[str, str]:
    """Diagnosis cohort, its labels and the warped, split cohort series."""
    tag = cohort_tag(code1, code2, item_codes)
    cohort = exclusive_cohort(diagnoses, roles.entity, diag_category, code1, code2)
    labels = cohort_labels(cohort, roles.entity, code1, code2, out=roles.category)
    series = build_cohort(events, items, diagnoses, roles=roles, item_codes=item_codes,
                          code1=code1, code2=code2, diag_category=diag_category, **cohort_kw)
    paths = {k: os.path.join(out_dir, f"{tag}_{k}") for k in ("diag", "categories", "series")}
    save_table(cohort, paths["diag"] + ".parquet")
    if csv:
        save_table(labels, paths["categories"] + ".csv", "csv")
    save_table(labels, paths["categories"] + ".parquet")
    save_series(series, paths["series"] + ".parquet", partition_by=["split"])
    if csv:
        stored = load_series(series.sparkSession, paths["series"] + ".parquet")
        save_table(stored, paths["series"] + ".csv", "csv", partition_by=["split"])
    return paths


def hyperparameter_job(spark: SparkSession, series_path: str, out_path: str, *, roles: Roles,
                       item_code: str, split: str = "train", **search_kw) -> str:
    """Grid search over the stored training series; writes one CSV row."""
    series = load_series(spark, series_path).where(F.col("split") == split)
    best = optimize_hyperparameters(series, roles, item_code=item_code, **search_kw)
    save_hyperparams(best, out_path)
    return out_path


def resample_job(spark: SparkSession, series_path: str, hyper_path: str, out_path: str, *,
                 roles: Roles, item_code: str | None = None, step: float = 0.25,
                 padding_length: float = 20.0, max_points: int | None = None,
                 csv: bool = False) -> str:
    """Resample every stored series (train and test) with the stored
    hyperparameters; writes the long predictions partitioned by split, with
    ``csv`` also as CSV part files at ``out_path`` + ``.csv``."""
    hp = load_hyperparams(spark, hyper_path, item_code)
    series = load_series(spark, series_path)
    pred = resample_cohort(series, roles, hp.sigma2, hp.alpha, hp.tau, step=step,
                           padding_length=padding_length, max_points=max_points)
    save_series(pred, out_path, partition_by=["split"])
    if csv:
        save_table(load_series(spark, out_path), out_path + ".csv", "csv", partition_by=["split"])
    return out_path


__all__ = ["cohort_tag", "matrix_job", "cohort_job", "hyperparameter_job", "resample_job"]
