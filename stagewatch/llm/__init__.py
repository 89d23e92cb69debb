"""Operators of a large-scale training-data pipeline. Nothing else in the library imports this.

Functions of this package that run in tasks are sent by value, so executors need only
the public libraries, not a copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
