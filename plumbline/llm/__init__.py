"""Operators of a training-data pipeline. Nothing else in the package imports this folder; `queries` registers its queries."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # task code travels with the job: executors need no copy of the package
