"""Spark jobs for the tabular machine-learning data lifecycle."""

import sys

from pyspark import cloudpickle

#: Functions travel to the executors with their code, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
