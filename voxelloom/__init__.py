"""Voxelloom: probabilistic voxel analytics and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are pickled by value, so executors don't need this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
