"""Point-in-time analytics for tables of two-sided contests, on Spark."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions of this package travel to the executors with the plan itself, so a
# cluster needs no copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
