"""zephyrframe: hourly sensor analytics as Spark DataFrame plans.

Functions of this package that run inside tasks are shipped by value, so
executors need no copy of it on their own disks.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
