"""Training-data operators: licence scans, de-duplication, sharding, quality
and toxicity scoring, tokenizing, vector search and decontamination.

Nothing outside this subpackage imports it.  Functions that run inside Python
tasks are shipped by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
