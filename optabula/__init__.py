"""optabula: linear models fitted by distributed convex optimization, as Spark tables.

Rows stay in Spark. A pass over the data is one Spark aggregation; only the
d-sized parameter vector, scalars and d x d sums reach the driver.
"""

from pyspark import cloudpickle

from . import kernels
from .sources import binary

# Executors get these small modules with the task, so they need numpy and
# pyarrow but no installed copy of this package.
cloudpickle.register_pickle_by_value(kernels)
cloudpickle.register_pickle_by_value(binary)
