"""Operators for preparing training text at scale."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value: they need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules["arcwise"])
