"""Change-stream analytics and training-data operators on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of the package go to the workers by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
