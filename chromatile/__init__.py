"""Raster and palette analytics as Spark DataFrame operators.

A raster is a table of pixels ``(image_id, y, x, r, g, b, a)``.  Every operator
is a function from DataFrames to DataFrames that keeps ``image_id`` as a key, so
one call works on a whole corpus of images.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
