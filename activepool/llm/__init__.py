"""Operators for preparing training text at scale; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Task functions travel whole, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
