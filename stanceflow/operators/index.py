"""Distributed row index (H1).

Positional operators (slice ranges, batches, positional alignment, target
shuffles) need a 0-based row number. ``row_number()`` over an unpartitioned
window moves every row into one task; here the order is cut into slices by
coarser keys that grow with the order key:

1. one extra pass, which reads the keys alone, counts the rows per slice;
   running sums over those counts (two levels, so no task holds them all) give
   each slice's offset;
2. a window per slice numbers the rows inside it, and the offset of its slice
   makes the number global.

Nothing runs when the plan is built. Slices are null-safe: null keys form a
slice of their own, first in ascending and last in descending order, as Spark
sorts them. Equal keys are numbered in ``tie_break`` order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A slice of an integer key spans 2^SLICE_BITS values; unique keys put at most
#: so many rows into one window task. The first level is 2^GROUP_BITS slices.
SLICE_BITS = 16
GROUP_BITS = 12

Order = tuple[Column, bool]  # expression, descending


def _sorted(column: Column, descending: bool) -> Column:
    return column.desc_nulls_last() if descending else column.asc_nulls_first()


def with_row_index_by(df: DataFrame, levels: Sequence[Order], order: Sequence[Order], out: str = "idx",
                      partition_by: Sequence[str] = ()) -> DataFrame:
    """0-based index in ``order`` (per ``partition_by`` group).

    ``levels`` are slice keys from coarse to fine, each monotone in ``order``;
    rows of one slice are numbered by one task, and so are the slices of one
    coarser slice."""
    parts = list(partition_by)
    names = [f"_l{i}" for i in range(len(levels))]
    keyed = df.withColumns({n: c for n, (c, _) in zip(names, levels, strict=True)})
    counts = keyed.groupBy(*parts, *names).agg(F.count(F.lit(1)).alias("_n"))
    offsets = None
    for depth in range(len(levels), 0, -1):
        keys = names[:depth]
        level = counts if depth == len(levels) else counts.groupBy(*parts, *keys).agg(F.sum("_n").alias("_n"))
        before = Window.partitionBy(*parts, *keys[:-1]).orderBy(_sorted(F.col(keys[-1]), levels[depth - 1][1])) \
            .rowsBetween(Window.unboundedPreceding, -1)
        part = level.select(*parts, *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_off{depth}"))
        offsets = part if offsets is None else _join_null_safe(offsets, part, [*parts, *keys])
    total = sum((F.col(f"_off{d}") for d in range(2, len(levels) + 1)), F.col("_off1"))
    offsets = offsets.select(*parts, *names, total.alias("_off"))
    inside = Window.partitionBy(*parts, *names).orderBy(*[_sorted(c, d) for c, d in order])
    numbered = keyed.withColumn("_local", F.row_number().over(inside) - 1)
    return (_join_null_safe(numbered, offsets, [*parts, *names])
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("long"))
            .drop(*names, "_local", "_off"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = right.select(*[F.col(k).alias(f"_r{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return left.join(named, on).drop(*[f"_r{k}" for k in keys])


def with_row_index(df: DataFrame, order_col: str, out: str = "idx", partition_by: Sequence[str] = (),
                   tie_break: Sequence[str] = (), descending: bool = False,
                   slice_bits: int = SLICE_BITS) -> DataFrame:
    """0-based index in the order of an integer key (per ``partition_by``
    group). ``slice_bits``: for keys spread over a wide range (hashes), the
    slices must be wide too, or there are as many as rows."""
    kind = df.schema[order_col].dataType
    if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError(f"{order_col} is {kind.simpleString()}: with_row_index needs an integer key")
    key = F.col(order_col).cast("long")
    levels = [(F.shiftright(key, bits), descending) for bits in (slice_bits + GROUP_BITS, slice_bits) if bits < 64]
    order = [(F.col(order_col), descending), *[(F.col(c), False) for c in tie_break]]
    return with_row_index_by(df, levels, order, out, partition_by)


#: md5('seed:key') cut to 60 bits: 4096 slices.
HASH_SLICE_BITS = 48


def hash_order(seed: int, key: str) -> Column:
    """A repeatable order key: the first 60 bits of md5('seed:key')."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def assign_batches(df: DataFrame, batch_size: int, order_col: str, shuffle_seed: int | None = None,
                   out: str = "batch") -> DataFrame:
    """Consecutive batches of ``batch_size`` rows (the last one short), in
    key order or, with a seed, in the repeatable order md5('seed:key')."""
    if shuffle_seed is None:
        from stanceflow.operators import ordering
        indexed = ordering.indexed(df, order_col, out="_pos")
    else:
        hashed = df.withColumn("_shuffle_key", hash_order(shuffle_seed, order_col))
        indexed = with_row_index(hashed, "_shuffle_key", out="_pos", tie_break=[order_col],
                                 slice_bits=HASH_SLICE_BITS).drop("_shuffle_key")
    return (indexed.withColumn(out, F.floor(F.col("_pos") / F.lit(batch_size)).cast("long"))
            .withColumnRenamed("_pos", "batch_pos"))
