"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# tasks carry the code of this subpackage, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
