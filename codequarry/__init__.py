"""Spark-native analytics engine for source-code audits and text corpora.

Functions that run on executors are pickled by value, so a cluster needs no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
