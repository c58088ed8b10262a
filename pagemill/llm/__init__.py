"""Training-data operators over tables of documents, pages and vectors."""

import sys

from pyspark import cloudpickle

# Ship these modules inside their UDFs, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
