"""Operators for text corpora that train language models, with their registered queries.

Every operator takes and returns DataFrames, selects the columns it needs by name and so is not disturbed by further columns, and keeps
rows apart by a row number of its own, so that repeated rows and null ids are rows like any others.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their jobs; the workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
