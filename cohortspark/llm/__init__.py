"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names and returns DataFrames; the ``opN_*`` queries in
:mod:`.queries` apply them to whole tables.
"""

import sys

from pyspark import cloudpickle

# Executors get this subpackage's functions with the tasks, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
