"""Corpus curation and boundary analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions that a plan ships
# to Python workers are pickled by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
