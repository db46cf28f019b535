"""pixelmill: Spark-first image analytics and corpus preparation.

Functions that run inside Python workers travel with the task (pickled by
value), so executors need only the third-party libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
