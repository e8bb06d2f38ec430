"""Emberline: fire-weather analytics and training-data operators, Spark first.

Everything is a DataFrame in and a DataFrame out.  The subpackage ``llm`` is
optional: nothing outside of it imports it.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their code, so executors needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
