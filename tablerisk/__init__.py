"""Privacy-risk analytics over tables, written as lazy PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: the few functions that run in Python workers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
