"""Operators for building training corpora.  Nothing else in the library imports this package.

Functions that run inside tasks are pickled by value, so executors need only the libraries
(numpy, pandas, regex, xxhash), not this package, on their Python path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
