"""Hydro-climatic risk analytics for daily division panels, on PySpark."""

import sys

from pyspark import cloudpickle

# Ship the package's small UDF bodies with the tasks: executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
