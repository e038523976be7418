"""Evidence-grounded knowledge cards on Spark DataFrames.

Functions handed to Spark's Python workers are pickled by value, so a cluster
needs the package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
