"""windrow: window analytics over multi-entity time-series telemetry, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
