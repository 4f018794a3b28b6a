"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Functions that run on executors are pickled by value, so executors need the
third-party libraries but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["voxelloom"])
