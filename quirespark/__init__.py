"""quirespark: document structure, text repair and text quality on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster
# needs nothing installed beside PySpark, numpy, pandas and pyarrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
