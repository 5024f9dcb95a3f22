"""Spark-native analytics for time-decaying, multi-channel knowledge graphs.

Functions that run in Python workers are shipped whole, so the workers need not
have the package on their path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
