"""Spark-native comparison and search of mass spectra."""

import sys

from pyspark import cloudpickle

# Executors receive the package's functions inside the task closure, so a job
# runs on a cluster without installing anything on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .params import LCSearchPlan, Params, default_params, lc_default_params  # noqa: E402,F401
