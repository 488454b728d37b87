"""signalmill: measure, compare, transform and govern large collections of sampled series on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions used inside tasks travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
