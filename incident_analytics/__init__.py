"""Spark-native analytics for service-desk tickets and language-model operations.

Every public operator takes and returns DataFrames.  Sub-packages:

``sources``    readers and writers (CSV exports, parquet stores, logs, reports)
``functions``  Column builders (no UDFs)
``operators``  table operators (curation, sampling, retrieval, reports, ...)
``plans``      multi-step jobs built from the operators
``streaming``  Structured Streaming counterparts
``catalog``    the queries registered for verification, with their SQL twins
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need no
# installed copy of this package (nor the driver's working directory).
cloudpickle.register_pickle_by_value(sys.modules[__name__])
