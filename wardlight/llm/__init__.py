"""Operators for large training-data pipelines."""

import sys

from pyspark import cloudpickle

# workers get the functions themselves, so they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
