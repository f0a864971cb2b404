"""newsmill: news-text analytics as PySpark DataFrame and Column functions."""

import sys

from pyspark import cloudpickle

# send this package's functions to the executors inside the job, so that nothing has to be
# installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
