"""leadframe: lead intelligence as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in tasks travel by value: executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
