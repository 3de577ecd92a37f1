"""Vehicle-trajectory and road-flow analytics written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python steps travel to the executors with their code, so a job needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
