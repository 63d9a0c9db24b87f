"""triagelake: ticket analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel whole, so that executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
