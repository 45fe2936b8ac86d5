"""Robustness perturbations and sweeps.

Every perturbation keeps the unperturbed target next to the new one
(``orig_target``, J4), so exports never need a second read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanceflow.operators.index import HASH_SLICE_BITS, hash_order, with_row_index
from stanceflow.operators.pairs import head_mask_column


def _only(split_col: str | None, split: str | None):
    if split_col and split:
        return F.col(split_col) == split
    return F.lit(True)


def mask_targets(df: DataFrame, target: str = "target", split_col: str | None = "split",
                 split: str | None = "test") -> DataFrame:
    """The target becomes '' (on the test split only, when a split column
    is given)."""
    cond = _only(split_col if split_col in df.columns else None, split)
    return (df.withColumn("orig_target", F.col(target))
            .withColumn(target, F.when(cond, F.lit("")).otherwise(F.col(target))))


def shuffle_targets(df: DataFrame, key: str, target: str = "target", seed: int = 1433) -> DataFrame:
    """A seeded permutation of the targets over the rows. Rows are
    numbered in key order, targets in the repeatable order md5('seed:key');
    row i takes the target numbered i (equi-join on the number), so the
    multiset of targets is kept exactly."""
    rows = with_row_index(df, key, out="_i")
    hashed = df.select(F.col(key).alias("_k"), F.col(target).alias("_t"), hash_order(seed, key).alias("_h"))
    donors = with_row_index(hashed, "_h", out="_i", tie_break=["_k"], slice_bits=HASH_SLICE_BITS).select("_i", "_t")
    return (rows.join(donors, "_i").withColumn("orig_target", F.col(target))
            .withColumn(target, F.col("_t")).drop("_i", "_t"))


def negate_targets(df: DataFrame, negations: DataFrame, target: str = "target", y: str = "y",
                   split_col: str | None = None, split: str | None = None) -> DataFrame:
    """Replace the target through the negation dictionary (unmapped
    targets unchanged) and flip labels 2 <-> 0 on every row, mapped or not.
    Repeated entries count once; a target with two different negations is an
    error, raised inside the plan."""
    low, high = F.min("negated"), F.max("negated")
    neg = negations.groupBy(F.col("target").alias("_t")).agg(
        F.when(low == high, low).when(low != high, F.raise_error(F.concat(
            F.lit("two negations of target "), F.first("target")))).alias("_neg"))
    cond = _only(split_col, split)
    out = df.join(neg, F.col(target) == F.col("_t"), "left").withColumn("orig_target", F.col(target))
    flipped = F.when(F.col(y) == 2, F.lit(0)).when(F.col(y) == 0, F.lit(2)).otherwise(F.col(y))
    return (out.withColumn(target, F.when(cond, F.coalesce(F.col("_neg"), F.col(target))).otherwise(F.col(target)))
            .withColumn("y_orig", F.col(y))
            .withColumn(y, F.when(cond, flipped).otherwise(F.col(y)).cast("int"))
            .drop("_t", "_neg"))


def explicit_flag(df: DataFrame, keywords: DataFrame, text: str = "text", target: str = "target") -> DataFrame:
    """T4: ``explicit`` is true for rows that mention a keyword of their target
    (case-sensitive substring). The lists of a repeated target count together.
    A target without keywords is an error, raised inside the plan when such a
    row is met."""
    kw = keywords.groupBy(F.col("target").alias("_t")).agg(
        F.when(F.count("keywords") > 0, F.flatten(F.collect_list("keywords"))).alias("_kw"))
    j = df.join(kw, F.col(target) == F.col("_t"), "left")
    hit = F.exists("_kw", lambda k: F.col(text).contains(k))
    flag = F.when(F.col("_kw").isNull(),
                  F.raise_error(F.concat(F.lit("no keywords for target "), F.col(target)))).otherwise(hit)
    return j.withColumn("explicit", flag.cast("boolean")).drop("_t", "_kw")


def explicit_split(df: DataFrame, keywords: DataFrame, text: str = "text",
                   target: str = "target") -> tuple[DataFrame, DataFrame]:
    """T4 as two frames (explicit, implicit); ``explicit_flag`` has both in one."""
    tagged = explicit_flag(df, keywords, text, target)
    return tagged.filter(F.col("explicit")), tagged.filter(~F.col("explicit"))


def sweep_grid(spark: SparkSession, alphas: Sequence[float], masks: Sequence[str], models: Sequence[str],
               seeds: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """T5: alpha x {masks, no mask} x model, plus one baseline (no awareness)
    per model -- the scripts repeat the baseline for every alpha, here it is
    listed once. One row per (run, seed)."""
    runs = []
    for m in models:
        runs.append(F.struct(F.lit(m).alias("model"), F.lit(None).cast("double").alias("alpha"),
                             F.lit(None).cast("string").alias("mask"), F.lit(False).alias("aware")))
        for a in alphas:
            for mk in [*masks, None]:
                runs.append(F.struct(F.lit(m).alias("model"), F.lit(float(a)).alias("alpha"),
                                     F.lit(mk).cast("string").alias("mask"), F.lit(True).alias("aware")))
    grid = spark.range(1).select(F.inline(F.array(*runs)))
    return grid.select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))


def sweep_with_masks(spark: SparkSession, masks: Sequence[str], layers: int = 12, heads: int = 12) -> DataFrame:
    """The (mask, layer, head, on) cells of every mask in a sweep."""
    arr = F.array(*[F.struct(F.lit(m).alias("mask"), head_mask_column(m, layers, heads).alias("g")) for m in masks])
    return spark.range(1).select(F.inline(arr)).select("mask", F.inline("g"))


def literal_frame(spark: SparkSession, mapping: Mapping, key: str, value: str, value_type: str) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), f"{key} string, {value} {value_type}")
