"""Operators for large training corpora: clustering, ranking, similarity search, splitting, cutoffs, packing, mixing, shared spans.

Nothing outside this subpackage imports it.  Functions that run in Python workers are shipped by value, so a
cluster needs no copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
