"""Lexispan: versioned-document analytics and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Kernels that run in Python workers travel by value, so executors need no copy
# of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
