"""docwatch: Spark operators for watching and curating growing document collections."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the plan, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
