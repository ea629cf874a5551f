"""Training-data operators over a table of documents.

Nothing outside this subpackage imports it. Its functions travel to the
executors by value, so they need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
