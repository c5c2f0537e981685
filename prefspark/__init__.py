"""Preference learning and review analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the package's functions by value, so executors (and the streaming state runner, which ignores
# added files) need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
