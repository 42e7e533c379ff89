"""Marlstone: key-value workload analytics on Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
