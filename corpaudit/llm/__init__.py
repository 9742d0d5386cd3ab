"""Operators for large training-data pipelines; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions and models sent to executors carry this package's code along, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
