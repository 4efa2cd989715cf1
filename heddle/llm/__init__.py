"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Functions that run inside Spark
tasks are shipped by value, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
