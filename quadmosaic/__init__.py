"""A PySpark engine for tiled, multi-resolution raster data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to executors whole, so that these need no installation of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
