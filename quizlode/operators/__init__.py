"""Operators: DataFrames in, DataFrames out."""

import importlib

from pyspark import cloudpickle

# what runs on executors goes there with its task, so that they need no copy of this package
cloudpickle.register_pickle_by_value(importlib.import_module("quizlode"))
