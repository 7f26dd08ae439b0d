"""Operators for preparing training data at corpus scale; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

#: Functions sent to executors travel by value, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
