"""DataFrame operators that turn captured pages into an instruction-tuning set."""

import sys

from pyspark import cloudpickle

# Functions run in Python workers travel with the job, so executors need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
