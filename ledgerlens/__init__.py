"""Filing analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python tasks carry the functions they need, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
