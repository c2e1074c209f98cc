"""heaploom: object-graph analytics and corpus operators as Spark plans.

The package is pickled by value, so a session can use it without shipping it
to the executors first.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
