"""Training-data operators: dedup, PII, quality, joins, decontamination, archives, mixing, sharding.

Nothing else in the library imports this package.  Functions that run inside
Python workers are shipped by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
