"""Weighted finite-state machines and text analytics on PySpark."""

import sys

from pyspark import cloudpickle

# workers get this package's functions with their code, so they need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
