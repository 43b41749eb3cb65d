"""Operators for training-data corpora. Nothing else in the package imports this one.

Functions that run in Python workers travel with the plan, so executors need the public
libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
