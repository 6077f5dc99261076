"""Demand planning on Spark: forecasts, ingredient needs and buying advice per series."""

import sys

from pyspark import cloudpickle

from larder.tables import FEATURES, Policy

# Functions sent to executors travel by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["FEATURES", "Policy"]
