"""Session helpers.

The library never creates a session behind the caller's back; these helpers
exist for tests, the bench and command-line use.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "stanceflow") -> SparkSession:
    """A session with the cluster's own settings; only what is passed here is
    set. The time zone is fixed to UTC and the web page stays off."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false") \
        .config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    Read from the session (``spark.checkpoint.dir``); without one this raises,
    as a folder of the driver alone would be lost on executors."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf = (spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
            or spark.conf.get("spark.checkpoint.dir", None))
    if not conf:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(conf)
    return spark.sparkContext.getCheckpointDir() or conf


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; the
    files go when the session's JVM ends. A local session without a folder gets
    a temporary one."""
    spark = df.sparkSession
    try:
        base = checkpoint_dir(spark)
    except RuntimeError:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stanceflow-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
