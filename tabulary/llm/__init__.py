"""Operators for preparing text corpora for language-model training.

Each module holds one operator with its own interface; ``queries`` derives the registered
queries from them. Nothing else in the library imports this package. Functions that run in
Python workers travel by value, so the workers need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
