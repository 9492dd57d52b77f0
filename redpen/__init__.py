"""redpen: dataset jobs for text shortening and text editing, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# kernels travel to the executors inside the job, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
