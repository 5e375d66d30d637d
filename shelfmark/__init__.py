"""Retail customer analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to the workers carry their code with them, so that a session works
# whether or not its executors have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
