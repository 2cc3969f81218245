"""A property-graph analytics engine for code and code-like data on Spark.

Functions that run on executors are pickled by value, so that executors need not have
the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # with all modules below
