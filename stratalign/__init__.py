"""Longitudinal snapshot analytics on Spark: identity resolution, first-seen dates, comparators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
