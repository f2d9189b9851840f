"""Training-data operators: dedup, packing, decontamination, quality, chat, sharding, WARC, HTML, PII.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with the jobs, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
