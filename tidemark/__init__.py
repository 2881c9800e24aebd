"""Sensor time series on PySpark."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
