"""Sinks (K1-K6). Writers are plain DataFrame writes: distributed, one file
per task, no driver-side loop over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stanceflow.functions.labels import decode_label
from stanceflow.sources.readers import GENERATION_COLUMNS


def _writer(df: DataFrame, fmt: str, mode: str):
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    return w


def write_generations(df: DataFrame, path: str, text: str = "text", target: str = "target",
                      stance: str = "stance", prompt: str = "prompt", generated: str = "generated_text",
                      fmt: str = "csv", mode: str = "overwrite") -> None:
    """K1: the six generation columns; ``Generated Stance`` is left blank."""
    out = df.select(F.col(text).alias(GENERATION_COLUMNS[0]), F.col(target).alias(GENERATION_COLUMNS[1]),
                    F.col(stance).alias(GENERATION_COLUMNS[2]), F.col(prompt).alias(GENERATION_COLUMNS[3]),
                    F.col(generated).alias(GENERATION_COLUMNS[4]), F.lit("").alias(GENERATION_COLUMNS[5]))
    _writer(out, fmt, mode).save(path)


def write_parsed(df: DataFrame, path: str, unmatched_path: str, stance: str = "generated_stance",
                 fmt: str = "csv", mode: str = "overwrite") -> int:
    """K2: the full parsed table, the rows whose stance is '' and their count.

    The count is observed by the write of the full table, so no job runs for it;
    tasks that are run again count once. The second write reads what the first
    one wrote, so ``df`` is computed once and kept nowhere; only for a format that
    may turn '' into null on its way back (CSV) does it read ``df`` again."""
    seen = Observation()
    told = df.observe(seen, F.count_if(F.col(stance) == "").alias("n_unmatched"), F.count(F.lit(1)).alias("n_rows"))
    _writer(told, fmt, mode).save(path)
    back = df if fmt == "csv" else df.sparkSession.read.schema(df.schema).format(fmt).load(path)
    _writer(back.filter(F.col(stance) == ""), fmt, mode).save(unmatched_path)
    return seen.get["n_unmatched"]


def export_predictions(df: DataFrame, path: str, tokens: str = "tokens", aspect_tokens: str = "orig_target_tokens",
                       new_target_tokens: str = "target_tokens", y: str = "y", p: str = "p",
                       masked: bool = False, partition_by: str | None = "seed", domain: str = "polarity",
                       only_errors: bool = False, mode: str = "overwrite") -> dict[str, int]:
    """K3: prediction export (all rows, or the y != p rows) with columns
    Tweet, Aspect, Polarity, New Target, Pred Aspect; a masked run writes
    'Target is Masked' as the new target. Returns n_rows and n_wrong (y != p) of
    ``df``, observed by the write itself."""
    new_target = F.lit("Target is Masked") if masked else F.array_join(new_target_tokens, " ")
    cols = [F.array_join(tokens, " ").alias("Tweet"), F.array_join(aspect_tokens, " ").alias("Aspect"),
            decode_label(y, domain).alias("Polarity"), new_target.alias("New Target"),
            decode_label(p, domain).alias("Pred Aspect")]
    seen, wrong = Observation(), ~F.col(y).eqNullSafe(F.col(p))
    told = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(wrong).alias("n_wrong"))
    src = told.filter(wrong) if only_errors else told
    extra = [partition_by] if partition_by else []
    out = src.select(*cols, *extra)
    w = _writer(out, "csv", mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.save(path)
    return seen.get


def append_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K4: results accumulate as a long table; the spreadsheet layout is a
    pivot of it (``metrics.results_wide``)."""
    _writer(df, fmt, "append").save(path)


RUN = "run_id"


def append_run(df: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> None:
    """K4 for runs that may be repeated: the rows of ``run_id`` replace what an
    earlier try of that run left, other runs stay as they are.

    Each run is a partition of its own, written by dynamic overwrite (the old
    rows go only when the new ones are committed); a run without rows leaves none.
    The table's manifest gets a row per run that is complete: ``read_runs`` shows
    those alone, so a try that died in between is not seen."""
    if not run_id:
        raise ValueError("a run needs a name")
    if RUN in {c.lower() for c in df.columns}:
        raise ValueError(f"the results have a column {RUN}")
    base, seen = path.rstrip("/"), Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn(RUN, F.lit(run_id))
    _replace_run(rows, f"{base}/rows", fmt)
    told = df.sparkSession.range(1).select(F.lit(seen.get["n"]).alias("n_rows"), F.lit(run_id).alias(RUN))
    _replace_run(told, f"{base}/manifest", "parquet")


def _replace_run(df: DataFrame, path: str, fmt: str) -> None:
    _writer(df, fmt, "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).save(path)


def read_runs(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The rows of all complete runs of ``append_run`` (``schema``: the results'
    columns), with their run_id."""
    base = path.rstrip("/")
    done = spark.read.schema(f"n_rows long, {RUN} string").parquet(f"{base}/manifest").where("n_rows > 0")
    reader = spark.read.schema(f"{schema}, {RUN} string").format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.load(f"{base}/rows").join(done.select(RUN), RUN, "left_semi")


def write_score_tables(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5: the mean and std tables of ``score_summary`` with a stat column
    (the reference appends the std table without a header)."""
    _writer(df.orderBy("stat", df.columns[1]).coalesce(1), "csv", mode).save(path)


def write_score_table_pair(mean: DataFrame, std: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5 as the two tables of ``metrics.score_tables``, each with its own
    columns, under ``path/mean`` and ``path/std``."""
    for name, table in (("mean", mean), ("std", std)):
        _writer(table.coalesce(1), "csv", mode).save(f"{path.rstrip('/')}/{name}")


def write_flat_aspects(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K6: flattened aspect rows, whole-row distinct, as CSV."""
    _writer(df.dropDuplicates(), "csv", mode).save(path)
