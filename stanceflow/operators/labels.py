"""Projections, filters and distinct over labelled frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanceflow.functions.labels import DOMAINS, decode_label, encode_label, encode_prediction
from stanceflow.operators.ordering import IN_ONE_TASK, Key, first_n


def encode_labels(df: DataFrame, col: str = "stance", out: str = "y", domain: str = "stance") -> DataFrame:
    """String label -> 0/1/2."""
    return df.withColumn(out, encode_label(col, domain))


def encode_predictions(df: DataFrame, col: str = "generated_stance", out: str = "p",
                       domain: str = "stance") -> DataFrame:
    """Missing -> -1, known -> 0/1/2, other strings -> null."""
    return df.withColumn(out, encode_prediction(col, domain))


def decode_labels(df: DataFrame, col: str = "y", out: str = "label", domain: str = "polarity") -> DataFrame:
    """0/1/2 -> names."""
    return df.withColumn(out, decode_label(col, domain))


def aux_frame(df: DataFrame, text: str = "text", target_id: str = "target_id", y: str = "y") -> DataFrame:
    """(text, target id, y) without class 1. The filter sits right after
    the scan, so Catalyst pushes it into the reader when y is stored."""
    return df.select(text, target_id, y).filter(F.col(y) != 1)


def distinct_rows(df: DataFrame) -> DataFrame:
    """P5: whole-row distinct (one partial + final hash aggregate)."""
    return df.dropDuplicates()


def head_limit(df: DataFrame, n: int, order_by: Key | Sequence[Key], in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """The first n rows in the given order (a true first-n); n <= 0 keeps
    every row. Keys are columns, (column, descending) pairs or sort expressions.
    Nulls sort as in Spark (first ascending, last descending); rows that tie at
    the edge are any of them. Large n run as a distributed selection
    (``ordering.first_n``)."""
    if n <= 0:
        return df
    one = isinstance(order_by, (str, Column)) or (isinstance(order_by, tuple) and len(order_by) == 2
                                                  and isinstance(order_by[1], bool))
    return first_n(df, n, [order_by] if one else list(order_by), in_one_task)


def split_valid(df: DataFrame, label_col: str = "stance", domain: str = "stance",
                text_col: str | None = "text") -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with a reason column).

    A label outside the domain is never silently dropped or passed through."""
    names = list(DOMAINS[domain])
    reason = (F.when(F.col(label_col).isNull(), F.lit("missing label"))
              .when(~F.col(label_col).isin(*names), F.lit("label outside domain")))
    if text_col:
        reason = reason.when(F.col(text_col).isNull(), F.lit("missing text"))
    tagged = df.withColumn("reason", reason)
    valid = tagged.filter(F.col("reason").isNull()).drop("reason")
    quarantine = tagged.filter(F.col("reason").isNotNull())
    return valid, quarantine


def label_profile(df: DataFrame, by: list[str]) -> DataFrame:
    """Row counts by every prefix of ``by`` (ROLLUP), incl. the total."""
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("n_rows"))
