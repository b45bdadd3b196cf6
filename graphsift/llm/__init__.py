"""Operators for building training corpora: deduplication, language
identification, web archives, extraction, tokenising, packing and filters.

Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
