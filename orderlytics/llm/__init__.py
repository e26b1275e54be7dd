"""Operators for preparing training text: tokenising, scoring, de-duplication,
packing, neighbour search and licence scans, one module per operator.

Nothing else in the library imports this subpackage. Its functions are pickled
by value, so executors need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
