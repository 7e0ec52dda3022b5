"""Covariance of clustering statistics, and the tables around it, on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this library travel to executors by value, so these need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
