"""Operators for preparing training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: functions they run travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules["voxloom"])
