"""Operators for preparing training text at scale. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions sent to the workers carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
