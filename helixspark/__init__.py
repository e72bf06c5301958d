"""Spark-first analytics for biological sequence catalogues and their training data."""

import sys

from pyspark import cloudpickle

# functions travel to the workers by value, so that executors need no installation of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
