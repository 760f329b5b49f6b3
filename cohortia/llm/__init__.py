"""Operators for preparing training text: filters, deduplication, packing, search and mixing.

Nothing else in the library imports this subpackage. Each module holds one
operator, its docstring states the result for odd input; ``queries`` applies
the operators to the given tables.
"""

import sys

from pyspark import cloudpickle

# Tasks get these functions by value: executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
