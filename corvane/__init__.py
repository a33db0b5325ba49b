"""corvane: labelled-corpus analytics expressed as lazy Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package by value, so a job needs no copy of
# the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
