"""Operators a training-data pipeline needs, each over whole tables of documents."""

import sys

from pyspark import cloudpickle

# Tasks get these modules with the functions they run, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
