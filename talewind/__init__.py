"""A Spark engine for narrative archives: transcripts, chat logs, and the graph of who they tell about."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
