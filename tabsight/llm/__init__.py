"""Operators of a training-data pipeline.  Nothing else in the library
imports this subpackage; functions that run on executors travel by value, so a
cluster need not have the package installed."""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
