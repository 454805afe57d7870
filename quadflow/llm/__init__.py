"""Training-data operators: filtering, classification, search, deduplication,
decontamination, web archives and tokenisation over Spark tables.

Nothing else in the library imports this subpackage. Its Python kernels are
shipped to executors by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
