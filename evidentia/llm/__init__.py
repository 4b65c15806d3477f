"""Operators for preparing large text corpora for language-model training.

Worker-side functions of this subpackage are pickled by value, so executors
need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
