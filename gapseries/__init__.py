"""gapseries: cohort and irregular-time-series analytics on Spark DataFrames."""

import sys as _sys

from gapseries.roles import Roles  # noqa: F401

__version__ = "0.1.0"

# Python UDFs (mapInPandas / pandas_udf) reference functions of this package.
# Pickling them by value ships their code with the task, so executors need no
# installed copy of the package (and no --py-files) to run them.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
