"""Operators that prepare text for training language models. Nothing outside this folder imports them.

Functions of this package travel to the executors by value, so a cluster needs numpy, pyarrow and the named libraries, but
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
