"""Registered queries over the benchmark tables, each with the SQL that checks it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
