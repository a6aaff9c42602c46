"""Training-data operators: search, near-duplicates, language models, audits, filters, tokenising.

Nothing else in the library imports this subpackage.  Its functions travel to
the executors by value, so a cluster needs no copy of the package there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
