"""Queries over the driver tables, with their SQL counterparts."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
