"""Operators of a training-data pipeline. Nothing outside this folder imports it.

Python kernels of this folder are shipped to executors by value, so that no executor needs this
repository on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
