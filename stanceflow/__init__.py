"""stanceflow: Spark-native engine for labelled (text, target) corpora.

Every operator takes and returns DataFrames and is built from Spark's own
expressions, joins, windows and aggregates.
"""

import sys

from stanceflow.session import checkpoint_dir, get_spark  # noqa: F401

# The few Python functions that run inside tasks (the Arrow-batched hooks)
# are shipped by value, so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship the package instead
    pass

__all__ = ["get_spark", "checkpoint_dir"]
