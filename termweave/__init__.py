"""termweave: ontology annotation of document collections, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship this package's Arrow functions by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
