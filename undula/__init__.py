"""undula: signals and training-data text as DataFrames.

Functions of this package are sent to executors by value, so that executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
