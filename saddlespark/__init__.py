"""Free-energy grids, trajectories and hills on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .functions.axis import Axis
from .functions.grid import GridSpec
from .functions.units import thermal_energy
from .operators.histogram import Histogram, bin_count, bin_mean, bin_sum, generate, lookup, reduce_dimension
from .operators.patches import Patch
from .session import build_session

__version__ = "0.1.0"

# The few functions that run in Python workers travel with their tasks, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Axis",
    "GridSpec",
    "Histogram",
    "Patch",
    "bin_count",
    "bin_mean",
    "bin_sum",
    "build_session",
    "generate",
    "lookup",
    "reduce_dimension",
    "thermal_energy",
]
