"""Spark-native analytics over labelled collections of small graphs and sparse feature sets.

The functions that run in Python workers are pickled by value, so executors need Spark, numpy,
pandas and pyarrow but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
