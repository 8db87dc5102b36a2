"""loomtext: corpus analytics expressed as Spark plans.

Functions of this package that run on executors are shipped by value, so that a
cluster needs neither a shared checkout nor an installed wheel.
"""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
