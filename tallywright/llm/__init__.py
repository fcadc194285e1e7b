"""Corpus operators for training-data pipelines.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries when it is present.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
