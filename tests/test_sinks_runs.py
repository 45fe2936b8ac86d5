"""Counts observed by writes, and results tables that survive repeated runs."""
import os

import pytest
from pyspark.sql import functions as F

from stanceflow.sources import sinks as K


def counting(spark, rows):
    """A frame and a counter of how many times each of its rows was computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema), seen


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_unmatched_count_comes_with_the_write(spark, tmp_dir, fmt):
    rows = spark.createDataFrame([(i, "" if i % 3 == 0 else "FAVOR") for i in range(100)], "id int, generated_stance string")
    df, seen = counting(spark, rows.repartition(5, "id"))
    n = K.write_parsed(df, f"{tmp_dir}/all", f"{tmp_dir}/none", fmt=fmt)
    assert n == 34 and seen.value == 100
    assert spark.read.format(fmt).load(f"{tmp_dir}/all").count() == 100
    assert spark.read.format(fmt).load(f"{tmp_dir}/none").count() == 34
    assert K.write_parsed(df.where("id < 0"), f"{tmp_dir}/a", f"{tmp_dir}/b", fmt=fmt) == 0


def test_count_is_right_when_tasks_run_again(spark, tmp_dir):
    """A shuffle file is lost between the stages: its map stage runs again."""
    rows = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") % 4 == 0, "").otherwise("NONE").alias("generated_stance"))
    mark = os.path.join(tmp_dir, "failed")

    def once(batches):
        for b in batches:
            if not os.path.exists(mark):
                open(mark, "w").close()
                from pyspark.errors import PySparkRuntimeError  # noqa: F401
                os._exit(1)  # the worker dies
            yield b

    df = rows.repartition(3, "id").mapInArrow(once, rows.schema)
    try:
        n = K.write_parsed(df, f"{tmp_dir}/all", f"{tmp_dir}/none", fmt="parquet")
    except Exception:  # a local master tries a task once: the caller runs the job again
        n = K.write_parsed(df, f"{tmp_dir}/all", f"{tmp_dir}/none", fmt="parquet")
    assert n == 250 and os.path.exists(mark)
    assert spark.read.parquet(f"{tmp_dir}/none").count() == 250


def test_prediction_export_tells_its_counts(spark, tmp_dir):
    df = spark.createDataFrame([(["a"], ["b"], ["c"], i % 3, i % 2, 1) for i in range(30)],
                               "tokens array<string>, orig_target_tokens array<string>, target_tokens array<string>, y int, p int, seed int")
    wrong = df.where("y != p").count()
    for only in (False, True):
        told = K.export_predictions(df, f"{tmp_dir}/{only}", only_errors=only)
        assert told == {"n_rows": 30, "n_wrong": wrong}
        assert spark.read.option("header", True).csv(f"{tmp_dir}/{only}").count() == (wrong if only else 30)


def results(spark, n, value):
    return spark.createDataFrame([(f"m{i}", value) for i in range(n)], "metric string, value double")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_run_appended_twice_is_there_once(spark, tmp_dir, fmt):
    schema = "metric string, value double"
    for run, n, value in (("a", 3, 1.0), ("b", 2, 2.0), ("a", 4, 3.0), ("c/d e", 1, 5.0)):
        K.append_run(results(spark, n, value), tmp_dir, run, fmt)
    got = K.read_runs(spark, tmp_dir, schema, fmt)
    assert sorted((r.run_id, r.metric, r.value) for r in got.collect()) == sorted(
        [("a", f"m{i}", 3.0) for i in range(4)] + [("b", f"m{i}", 2.0) for i in range(2)] + [("c/d e", "m0", 5.0)])
    K.append_run(results(spark, 0, 0.0), tmp_dir, "b", fmt)
    assert {r.run_id for r in K.read_runs(spark, tmp_dir, schema, fmt).collect()} == {"a", "c/d e"}


def test_a_run_that_died_is_not_seen(spark, tmp_dir):
    K.append_run(results(spark, 2, 1.0), tmp_dir, "good")
    K._replace_run(results(spark, 5, 9.0).withColumn("run_id", F.lit("half")), f"{tmp_dir}/rows", "parquet")
    assert {r.run_id for r in K.read_runs(spark, tmp_dir, "metric string, value double").collect()} == {"good"}
    K.append_run(results(spark, 1, 4.0), tmp_dir, "half")
    assert K.read_runs(spark, tmp_dir, "metric string, value double").count() == 3


def test_names_that_cannot_be(spark, tmp_dir):
    with pytest.raises(ValueError):
        K.append_run(results(spark, 1, 1.0), tmp_dir, "")
    with pytest.raises(ValueError):
        K.append_run(results(spark, 1, 1.0).withColumn("RUN_ID", F.lit(1)), tmp_dir, "x")
