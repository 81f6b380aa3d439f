"""Document-evidence analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so that workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
