"""Spark-native analytics for gridded, meshed and point-cloud data."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
