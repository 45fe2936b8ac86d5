"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import hashlib
import pickle
import sys
import tempfile
import types
import uuid
from collections import OrderedDict

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()``
#: without an argument splits on exactly these six characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: A-Z to a-z, every other byte unchanged (UTF-8 continuation bytes included).
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, as executors would not see the
    driver's files."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stanceflow-llm-"))
        found = sc.getCheckpointDir()
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts
    the lineage, and a lost executor costs only the re-read of its files."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Objects that a worker process keeps; the one unused for longest goes first.
KEPT = 6


def worker_store() -> OrderedDict:
    """A dictionary that lives as long as the Python worker process, so caches
    outlast one task. (Functions pickled by value get fresh globals per task;
    this one hangs on an entry of ``sys.modules``.)"""
    name = "_stanceflow_llm_worker"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].store = OrderedDict()
    return sys.modules[name].store


def cached(key, make):
    """The worker's object of that key, made when it has none."""
    store = worker_store()
    if key not in store:
        store[key] = make()
        while len(store) > KEPT:
            store.popitem(last=False)
    store.move_to_end(key)
    return store[key]


def release_memory() -> None:
    """Give freed memory back to the system at a task's end: idle workers stay
    alive beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Shared:
    """A broadcast object of this subpackage. It travels as cloudpickle bytes
    (classes by value, so executors need no copy of the package) and is
    rebuilt once per worker process. For objects of a fixed or stated size."""

    def __init__(self, spark: SparkSession, value):
        data = cloudpickle.dumps(value)
        self.key = ("shared", hashlib.sha256(data).hexdigest())
        self.sent = spark.sparkContext.broadcast(data)

    def __call__(self):
        return cached(self.key, lambda: pickle.loads(self.sent.value))


def words_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text, in order."""
    return F.array_remove(F.split(text, SPACE_CLASS, -1), "")


def free_name(base: str, taken) -> str:
    """``base``, with underscores added until no column has that name (Spark
    compares column names without case)."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
