"""Spark operators for ordered, multi-author edit logs over hierarchical scenes."""

import sys

from pyspark import cloudpickle

#: Functions sent to executors carry their code, so that nodes need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
