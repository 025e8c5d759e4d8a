"""Operators that prepare text for training language models."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this subpackage with the job: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
