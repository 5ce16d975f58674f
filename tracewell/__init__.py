"""Log analytics and training-data preparation as PySpark DataFrame verbs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that a job also runs
# on executors that do not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
