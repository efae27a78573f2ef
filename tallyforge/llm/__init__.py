"""Operators for training data: labelling, deduplication, mixing, formatting, tokens and search.

Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job; they need no copy of it there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
