"""Parsing generated text (L1-L5) over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceflow.functions.parse import parse_chat, parse_dict, parse_free

PARSERS = {"free": parse_free, "dict": parse_dict, "chat": parse_chat}


def parse_generations(df: DataFrame, parser: str = "free", text: str = "generated_text",
                      out: str = "generated_stance") -> DataFrame:
    return df.withColumn(out, PARSERS[parser](text))


def unmatched(df: DataFrame, stance: str = "generated_stance") -> DataFrame:
    """L4: the rows the parser could not read."""
    return df.filter(F.col(stance) == "")


def unmatched_rate(df: DataFrame, by: Sequence[str] = (), stance: str = "generated_stance") -> DataFrame:
    """L4: unmatched count and the abstention rate per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(stance) == "").alias("n_unmatched"),
        F.avg((F.col(stance) == "").cast("double")).alias("unmatched_rate"))


def unknown_count(df: DataFrame, by: Sequence[str] = (), p: str = "p") -> DataFrame:
    """Predictions equal to -1 (and, ours, unmapped strings = null)."""
    return df.groupBy(*by).agg(F.count_if(F.col(p) == -1).alias("n_unknown"),
                               F.count_if(F.col(p).isNull()).alias("n_unmapped"),
                               F.count(F.lit(1)).alias("n_rows"))
