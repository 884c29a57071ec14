"""Operators for preparing training data (filters, scans, joins, packing).

Nothing else in the library imports this subpackage. Its registered queries
are in ``patchloom.llm.queries``. Python functions defined here are shipped to
executors by value, so that workers need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
