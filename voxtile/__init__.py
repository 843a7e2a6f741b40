"""voxtile: a Spark-native engine for time-segmented speech and text data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code with them: the workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
