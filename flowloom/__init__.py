"""flowloom: labelled network-flow analytics as plain Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
