"""Symbolic anomaly detection for very large sets of time series, on Spark."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: its functions travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
