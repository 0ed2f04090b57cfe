"""Operators for preparing text corpora: tokens, files, filters, duplicates, quality, packing, search.

Functions of this package travel to the executors by value, so workers need not
be able to import it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
