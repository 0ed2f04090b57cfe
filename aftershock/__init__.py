"""Event-impact analytics as PySpark DataFrame operators.

Releases of economic indicators are cleaned, joined to the market before and
after them, scored against their own history, bundled, labelled, profiled and
used to train models.  Every operator takes and returns DataFrames.

Functions of this package travel to the executors by value, so workers need not
be able to import it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
