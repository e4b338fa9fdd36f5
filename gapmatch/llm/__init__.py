"""Operators of a training-data pipeline.

Functions of this package that run in tasks are shipped by value, so that
executors need numpy, pandas and pyarrow but no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
