"""Spark-native retrieval, indexing and corpus engine.

Functions that run inside Python workers are pickled by value, so a job needs
the package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
