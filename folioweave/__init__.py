"""Document-graph analytics on Spark.

Functions that run on executors are pickled by value, so that a cluster needs
no copy of this package beside the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
