"""Operators for training-data pipelines: de-duplication, filters, mixing, scoring and search."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
