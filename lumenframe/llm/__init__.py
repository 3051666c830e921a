"""Corpus operators for training data. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
