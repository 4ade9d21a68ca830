"""strandloom - sequence-composition analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions run in tasks travel with their code: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
