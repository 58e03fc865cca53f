"""galvan: a Spark-first analytics engine for text and aligned-speech corpora."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions for executors travel with the job, so that no worker needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
