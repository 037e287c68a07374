"""Parallel-text alignment, comparison and screening as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Tasks carry the package's own functions with them, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
