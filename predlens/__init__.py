"""Predictor analytics on Spark: ratio statistics, trailing features, association
measures, binned response effects, ranking reports and classifier comparisons."""

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the Python workers whole, so executors need no copy of it.
cloudpickle.register_pickle_by_value(__import__(__name__))
