"""Spark-native analysis of source corpora, reply logs and the findings drawn from them.

Functions that run in tasks are sent by value, so executors need the libraries that the package
uses but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
