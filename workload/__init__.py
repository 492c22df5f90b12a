"""The registered queries: feedlake operators over the given tables, each with the same result in SQL where SQL can say it."""

import sys

from pyspark import cloudpickle

from . import pipelines, relational, texts, updates
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "pipelines", "relational", "texts", "updates"]

# The stand-in models run in Python workers, which may not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
