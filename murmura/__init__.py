"""Media-monitoring and reputation analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Helper functions of Pandas/Arrow operators travel to the executors by value,
# so the cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
