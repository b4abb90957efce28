"""Spark-native analytics over the history of multi-step, multi-worker runs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel by value, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
