"""Layered agent-memory analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the package's functions with each job, so that executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
