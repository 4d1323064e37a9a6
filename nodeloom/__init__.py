"""Graph-feature data work on Spark: every operator takes and returns DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel inside the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
