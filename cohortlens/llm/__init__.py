"""Operators for training-data pipelines; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# tasks get the functions of this package with the job: workers need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
