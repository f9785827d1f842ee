"""Operators that prepare text for training language models.

Functions of this subpackage that run in executors are shipped by value, so that
only the driver needs the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
