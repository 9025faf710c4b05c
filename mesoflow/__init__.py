"""Particle-track and crystal-structure analytics, written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
