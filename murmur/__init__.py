"""Public-opinion event analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# the small Python helpers travel with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
