"""Operators for building training corpora, each over whole tables on Spark.

Nothing else in the library imports this subpackage.  Python helpers travel
inside the tasks, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
