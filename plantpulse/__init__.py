"""Spark-native analytics for equipment sensor data."""

import sys

from pyspark import cloudpickle

from plantpulse.operators.order import SeriesSpec

# functions sent to Python workers travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["SeriesSpec"]
