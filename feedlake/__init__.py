"""feedlake: feeds, transcripts, summaries and digests as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with their jobs, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
