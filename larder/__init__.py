"""Saved-content retrieval, ingestion and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions used in tasks travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
