"""Operators on text corpora for training data, one module each."""

import sys

from pyspark import cloudpickle

# What runs in tasks is sent with them: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
