"""Training-data operators: search, sharding, scoring, packing, mixing and deduplication.

Nothing outside this package (and ``corpus_pipeline.py``) imports it, so it can be removed whole.
Its functions are shipped to executors by value: a cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
