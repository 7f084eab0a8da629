"""Operators of a large-scale text pipeline (deduplication, cleaning, tokenizing, formatting).

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; the
``opN_*`` queries in ``registry`` apply them to the test tables.

What tasks run is sent to the executors by value, so they need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
