"""Compound-screening analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so it only has to
# be installed where the driver runs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
