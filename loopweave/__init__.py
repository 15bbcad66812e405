"""loopweave: a PySpark-native engine for antibody-loop structure comparison."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
