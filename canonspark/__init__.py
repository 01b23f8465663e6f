"""canonspark: short-text profiling, clustering and standardisation on Spark.

Every operator takes and returns Spark DataFrames.  Results depend on an
explicit occurrence order (``occ``), never on the physical layout.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# UDF helpers travel to the Python workers by value, so executors need no
# installed copy of this package (works under any session, local or cluster).
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from canonspark.session import get_spark, ensure_checkpoint_dir  # noqa: E402

__all__ = ["get_spark", "ensure_checkpoint_dir"]
