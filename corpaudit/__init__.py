"""Corpus audit, similarity and assembly of scholarly documents as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code along, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
