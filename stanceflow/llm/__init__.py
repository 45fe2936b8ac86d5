"""Training-data operators for text corpora at scale.

Ten operators (secret scans, SimHash near-duplicates, BPE encoding, weakly
supervised quality rules, a factorisation-machine classifier, entropy-coded
token files, license scans, token counts, a hash-prefix forest and mixing by
proportional fitting). Nothing outside this subpackage imports it, except the
guarded registration in ``__spark_entry__.py`` and ``corpus_pipeline.py``.

Functions that run inside Spark's Python workers are pickled by value, so the
executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
