"""Structured Streaming use of the operators.

Cleaning, prompt rendering, parsing and label encoding are stateless column
expressions, so they run unchanged on a streaming DataFrame. The evaluation
counters (per-target confusion counts) are a streaming aggregation whose
state is the handful of counters per target; F1 is derived from them in
each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanceflow.functions.labels import encode_prediction
from stanceflow.functions.parse import parse_chat, parse_dict, parse_free
from stanceflow.operators.metrics import CLASSES, f1_expr

PARSERS = {"free": parse_free, "dict": parse_dict, "chat": parse_chat}


def read_generation_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream of generation records (parquet); the schema is
    taken from the files already there (streams need it up front)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def parsed_stream(stream: DataFrame, parser: str = "free", text: str = "generated_text") -> DataFrame:
    """Stateless: parse + encode each generated text as it arrives."""
    return (stream.withColumn("generated_stance", PARSERS[parser](text))
            .withColumn("p", encode_prediction("generated_stance")))


def running_confusion(parsed: DataFrame, target: str = "target", y: str = "y", p: str = "p") -> DataFrame:
    """Stateful: per-target counters, updated per micro-batch."""
    yc, pc = F.col(y), F.col(p)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in CLASSES:
        aggs += [F.count_if((yc == c) & (pc == c)).alias(f"tp_{c}"), F.count_if(pc == c).alias(f"np_{c}"),
                 F.count_if(yc == c).alias(f"ns_{c}")]
    return parsed.groupBy(target).agg(*aggs)


def f1_from_counters(counts: DataFrame, target: str = "target") -> DataFrame:
    f = [f1_expr(F.col(f"tp_{c}"), F.col(f"np_{c}"), F.col(f"ns_{c}")) for c in CLASSES]
    return counts.select(target, "n_rows", ((f[0] + f[2]) / 2).alias("f1"))


def run_available_now(stream: DataFrame, sink_path: str, checkpoint: str, output_mode: str = "append",
                      fmt: str = "parquet") -> None:
    """Process everything present now, then stop (``availableNow``)."""
    q = (stream.writeStream.format(fmt).outputMode(output_mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink_path))
    q.awaitTermination()


def run_counters_available_now(counts: DataFrame, checkpoint: str, sink_path: str) -> None:
    """Write the per-target F1 of every micro-batch's updated counters
    (``foreachBatch``). Each batch overwrites its own ``batch_id=`` folder,
    so a batch replayed after a failure replaces its output instead of
    appending a duplicate."""
    def write(batch: DataFrame, batch_id: int) -> None:
        f1_from_counters(batch).write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")

    q = (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
