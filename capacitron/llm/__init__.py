"""Operators for large-scale training-data pipelines (quality, archives, dedup, tokens).

Each module holds one operator with a general interface; :mod:`.queries` wraps them into the
thin ``opN_<name>`` queries and their DuckDB statements.  Nothing outside this package imports
it, so the folder can be removed without touching the rest of the library.
"""

import sys

from pyspark import cloudpickle

# Tasks receive this package's functions by value: executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
