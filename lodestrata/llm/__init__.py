"""Operators that prepare training corpora.  Nothing outside this package uses it."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel with the tasks: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
