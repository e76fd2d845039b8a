"""Operators for preparing training text at scale. Nothing outside this package imports it, corpus_pipeline.py excepted."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
