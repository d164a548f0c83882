"""Cell-image analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python helpers travel with the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
