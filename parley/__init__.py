"""parley: Spark-native analytics for multi-tenant website-assistant data.

Every operator takes DataFrames and returns a lazy DataFrame that covers all
tenants in one job; ``tenant_id`` is a column, never a loop variable.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions travel to executors by value, so a cluster needs no copy of
# this package next to the workers.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
