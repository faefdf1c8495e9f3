"""Q3 (hyperparameter search) and Q4 (resampling) over a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapseries.operators import gp
from gapseries.operators.series import T_REL, T_WARP, build_series
from gapseries.roles import Roles


def gp_partitions(df: DataFrame) -> int:
    """Partitions for the CPU-bound GP stage.

    ``spark.sql.shuffle.partitions``, the setting that grows with the data, and
    two tasks per core at least.  Given as a number, so that AQE does not
    coalesce arrays that are small in bytes but heavy to factorise.
    """
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               2 * spark.sparkContext.defaultParallelism)


def cohort_series_arrays(cohort: DataFrame, roles: Roles, max_points: int | None = None,
                         partitions: int | None = None,
                         extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Nested series (keys, t, tw, v) spread over the GP tasks by one shuffle."""
    keys = roles.series_key + [k for k in extra_keys if k in cohort.columns]
    return build_series(cohort, keys, roles.value, t=T_REL, tw=T_WARP, tie=roles.tie,
                        max_points=max_points, partitions=partitions or gp_partitions(cohort))


def optimize_hyperparameters(cohort: DataFrame, roles: Roles, *, item_code: str | None = None,
                             sigma2=gp.DEFAULT_SIGMA2, alpha=gp.DEFAULT_ALPHA,
                             tau=gp.DEFAULT_TAU, accumulate: bool = False,
                             max_points: int | None = None, kernel: str = "rq",
                             partitions: int | None = None, long_points: int | None = None) -> DataFrame:
    """One row: sigma2, alpha, tau, log_likelihood, item_code, at_grid_edge
    (true argmax of the summed log likelihood over the grid)."""
    arr = cohort_series_arrays(cohort, roles, max_points, partitions)
    lls = gp.gp_grid_search(arr, sigma2, alpha, tau, accumulate, kernel=kernel,
                            partitions=partitions or gp_partitions(cohort), long_points=long_points)
    best = gp.grid_argmax(lls, sigma2, alpha, tau)
    return best.select("sigma2", "alpha", "tau", "log_likelihood",
                       F.lit(item_code).cast("string").alias("item_code"), "at_grid_edge")


def resample_cohort_arrays(cohort: DataFrame, roles: Roles, sigma2: float, alpha: float, tau: float,
                           *, step: float = 0.25, padding_length: float = 20.0,
                           max_points: int | None = None, partitions: int | None = None,
                           kernel: str = "rq", extra_keys: tuple[str, ...] = ("split",),
                           long_points: int | None = None) -> DataFrame:
    """One row per series: keys, t0, mean and variance arrays (+ ``extra_keys``)."""
    arr = cohort_series_arrays(cohort, roles, max_points, partitions, extra_keys)
    keys = [c for c in arr.columns if c not in ("t", "tw", "v")]
    return gp.gp_resample_arrays(arr, keys, sigma2, alpha, tau, step, padding_length, kernel=kernel,
                                 long_points=long_points)


def resample_cohort(cohort: DataFrame, roles: Roles, sigma2: float, alpha: float, tau: float,
                    *, step: float = 0.25, **kw) -> DataFrame:
    """Every series on a regular grid with GP mean and variance (long form):
    keys, i, t_warped, mean, variance (+ ``extra_keys`` carried through)."""
    arrays = resample_cohort_arrays(cohort, roles, sigma2, alpha, tau, step=step, **kw)
    keys = [c for c in arrays.columns if c not in ("t0", "mean", "variance")]
    return gp.flatten_resampled(arrays, keys, step)
