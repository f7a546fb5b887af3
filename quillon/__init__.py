"""Spark-native engine for privacy-aware data processing and detector evaluation."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that only the driver needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
