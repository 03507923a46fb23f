"""Open-set re-identification analytics on PySpark DataFrames."""

from pyspark import cloudpickle

from fieldmark.operators import kernels

# The in-task NumPy helpers travel with the query, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(kernels)
