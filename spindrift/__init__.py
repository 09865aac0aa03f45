"""Agent-run analytics on Spark.

Functions of this package are pickled by value, so that executors need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
