"""sparkloom: lazy DataFrame queries and an equivalent SQL front-end, planned and run by Spark.

The package adds to Spark what its users would otherwise decide query by query: one null order, strict column names,
join strategies by name, one-pass statistics, checkpoints and metrics. Everything returns plain DataFrames.
"""

import sys

from pyspark import cloudpickle

from .session import SessionOptions, create_session

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

__version__ = "0.1.0"
__all__ = ["SessionOptions", "create_session", "__version__"]
