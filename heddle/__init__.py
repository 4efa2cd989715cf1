"""Spark jobs for catalogs of linked content: merging, link quality, entities, search."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel by value, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
