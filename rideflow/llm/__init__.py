"""Operators that prepare text corpora for training language models."""

import sys

from pyspark import cloudpickle

# Executors needn't have this package: its functions travel with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
