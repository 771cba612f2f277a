"""Spark-native analytics for post-training data: evaluation records, rollout batches, prompt pools and token algebra."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the task itself, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
