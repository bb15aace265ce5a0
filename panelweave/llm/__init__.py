"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Functions that run in
Spark's Python workers are shipped with the job, so executors need no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
