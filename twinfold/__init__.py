"""Spark jobs for reviewing bilingual documents and page structure at corpus scale."""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the task: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
