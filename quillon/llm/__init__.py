"""Operators of a training-data pipeline and the queries that apply them.

Nothing else in the library imports this subpackage. Its functions travel to the executors
by value, so that they need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
