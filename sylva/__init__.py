"""sylva: gradient-boosted trees and feature engineering on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors inside the task, so a
# cluster needs no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
