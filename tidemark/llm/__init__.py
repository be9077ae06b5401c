"""Operators for preparing training data for language models, and their registered queries."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
