"""Entity-by-time panel analytics written as ordinary Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from panelyard.session import get_session

# The few functions that run inside tasks travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
