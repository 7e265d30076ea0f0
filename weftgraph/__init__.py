"""A PySpark-native engine for property graphs, source text and event logs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with the plan: executors need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
