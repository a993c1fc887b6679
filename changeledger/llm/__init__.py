"""Operators for training-data pipelines; nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# what runs in tasks travels with them: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
