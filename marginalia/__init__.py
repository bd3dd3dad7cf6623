"""Spark-native knowledge retrieval and corpus governance."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
