"""Dataset preparation and model-evaluation operators for PySpark."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
