"""Operators that prepare text for training language models.

Nothing else in the library imports this folder. Functions that run inside tasks are
shipped with the task itself, so executors need numpy, pandas and pyarrow, not this code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
