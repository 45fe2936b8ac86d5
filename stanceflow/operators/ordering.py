"""Row numbers and first-n selection for keys of any orderable type.

``number_rows``: Spark samples the keys and deals the rows out in ranges of the
sort order; a row number of the input splits equal keys, so one value that all
rows share is dealt out as well. Each range is sorted in its own task and its
rows numbered from 0; the counts of the ranges (one row per range) give offsets.
The dealt rows are written once, so counts and numbers see the same ranges.

``first_n``: nothing is sorted. A few sampled keys cut the rows into ranges, one
aggregation counts the rows up to each cut, and the range in which the n-th row
lies is cut again, until it is small; the result is a filter, plus the first rows
of that last range.

Nulls sort first in ascending and last in descending order, NaN as the largest
number, as in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceflow.session import staged

Key = str | tuple[str, bool] | Column  # a column, (a column, descending), or a sort expression

#: monotonically_increasing_id is the partition number above so many bits of row number.
LOCAL_BITS = 33
#: Rows that one task may sort for the end of a selection.
IN_ONE_TASK = 10_000
#: Sampled keys of a round.
CUTS = 64
#: Types whose values travel to the driver and back as they are.
PLAIN = (T.StringType, T.BooleanType, T.BinaryType, T.DecimalType, T.DoubleType, T.FloatType, T.LongType,
         T.IntegerType, T.ShortType, T.ByteType, T.DateType)


def sorted_by(key: Key) -> Column:
    if isinstance(key, Column):
        return key
    name, descending = key if isinstance(key, tuple) else (key, False)
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_first()


def _free(base: str, columns: Sequence[str]) -> str:
    low = {c.lower() for c in columns}
    while base.lower() in low:
        base += "_"
    return base


def dealt(df: DataFrame, sort: Sequence[Column], place: str, partitions: int | None = None) -> DataFrame:
    """``df`` in sorted ranges of about the same size, with ``place``: the range's
    number above LOCAL_BITS of the row's number in it."""
    spread = _free("_spread", df.columns)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(n, *sort, spread) \
        .sortWithinPartitions(*sort, spread).drop(spread).withColumn(place, F.monotonically_increasing_id())


def number_rows(df: DataFrame, order: Sequence[Key], out: str = "idx", partition_by: Sequence[str] = (),
                tie_break: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """0-based ``out`` in ``order`` (per ``partition_by`` group), whatever the
    keys' types, spread and repetition. Rows that tie after ``tie_break`` get
    their numbers in any order. Runs one job when called."""
    parts = list(partition_by)
    place = _free("_place", df.columns)
    rows = staged(dealt(df, [sorted_by(k) for k in [*parts, *order, *tie_break]], place, partitions), "numbered")
    part, offset = _free("_part", rows.columns), _free("_offset", rows.columns)
    counts = rows.groupBy(F.shiftrightunsigned(place, LOCAL_BITS).alias(part)).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset))
    local = F.col(place).bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    # one row per range of the deal: as many as there are partitions
    numbered = rows.withColumn(part, F.shiftrightunsigned(place, LOCAL_BITS)).join(F.broadcast(offsets), part) \
        .withColumn(out, F.col(offset) + local).drop(part, offset, place)
    if not parts:
        return numbered
    names = {p: _free(f"_g_{p}", numbered.columns) for p in parts}
    first = _free("_first", numbered.columns)
    starts = numbered.groupBy(*[F.col(p).alias(n) for p, n in names.items()]).agg(F.min(out).alias(first))
    return numbered.join(starts, [F.col(p).eqNullSafe(F.col(n)) for p, n in names.items()]) \
        .withColumn(out, F.col(out) - F.col(first)).drop(*names.values(), first)


def _upto(keys: Sequence[tuple[str, bool, T.DataType]], bound: Sequence) -> Column:
    """Whether a row sorts up to ``bound`` (equal keys included); never null."""
    later = F.lit(True)
    for (name, descending, kind), value in reversed(list(zip(keys, bound, strict=True))):
        c, v = F.col(name), F.lit(value).cast(kind)
        if value is None:
            less = c.isNotNull() if descending else F.lit(False)
        elif descending:
            less = F.coalesce(c > v, F.lit(False))
        else:
            less = F.coalesce(c < v, F.lit(True))
        later = less | (c.eqNullSafe(v) & later)
    return later


def first_n(df: DataFrame, n: int, order: Sequence[Key], in_one_task: int = IN_ONE_TASK,
            cuts: int = CUTS) -> DataFrame:
    """The first ``n`` rows in ``order`` (rows that tie at the edge are any of
    them), in no particular order. Up to ``in_one_task`` rows Spark's own top-n
    does it; beyond, counting jobs over the key columns run when called."""
    if n <= in_one_task:
        return df.orderBy(*[sorted_by(k) for k in order]).limit(n)
    named = [k if isinstance(k, tuple) else (k, False) for k in order if not isinstance(k, Column)]
    if len(named) < len(order) or not all(isinstance(df.schema[c].dataType, PLAIN) for c, _ in named):
        place = _free("_first_n", df.columns)
        return number_rows(df, order, place).where(F.col(place) < n).drop(place)
    keys = [(c, d, df.schema[c].dataType) for c, d in named]
    narrow, sort = df.select(*dict.fromkeys(c for c, _ in named)), [sorted_by(k) for k in named]
    low, high, left, size = None, None, n, None

    def inside(frame):
        """Rows after the cut ``low`` and up to ``high``."""
        for cond in ([] if low is None else [~_upto(keys, low)]) + ([] if high is None else [_upto(keys, high)]):
            frame = frame.where(cond)
        return frame

    while True:
        chance = F.xxhash64(*[F.col(c) for c, _ in named])
        bounds = inside(narrow).orderBy(chance).limit(cuts).distinct().orderBy(*sort).collect()
        bounds = [tuple(b[c] for c, _ in named) for b in bounds]
        counted = inside(narrow).agg(F.count(F.lit(1)), *[F.count_if(_upto(keys, b)) for b in bounds]).first()
        total, upto = counted[0], list(counted[1:])
        if total <= left:
            return inside(df) if low is None else df.where(_upto(keys, low)).unionByName(inside(df))
        fits = [i for i, c in enumerate(upto) if c <= left]
        if fits:
            low, left = bounds[fits[-1]], left - upto[fits[-1]]
        if len(fits) < len(bounds):
            high = bounds[len(fits)]
        rest = (upto[len(fits)] if len(fits) < len(bounds) else total) - (upto[fits[-1]] if fits else 0)
        done = None if low is None else df.where(_upto(keys, low))
        if not left:
            return done
        if rest <= in_one_task:
            back = [sorted_by((c, not d)) for c, d in named]
            edge = tuple(inside(narrow).orderBy(*sort).limit(left).orderBy(*back).first()[c] for c, _ in named)
            if inside(narrow).where(_upto(keys, edge)).count() == left:  # no tie there: a filter does it
                return df.where(_upto(keys, edge))
            return reduce(DataFrame.unionByName, [x for x in (done, inside(df).orderBy(*sort).limit(left)) if x])
        if rest == size:  # one key that all remaining rows share: any of them
            place = _free("_first_n", df.columns)
            tied = number_rows(inside(df), named, place).where(F.col(place) < left).drop(place)
            return reduce(DataFrame.unionByName, [x for x in (done, tied) if x])
        size = rest


def indexed(df: DataFrame, key: str, out: str = "idx", partition_by: Sequence[str] = (),
            tie_break: Sequence[str] = ()) -> DataFrame:
    """``index.with_row_index`` for integer keys, ``number_rows`` for all others."""
    if isinstance(df.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        from stanceflow.operators.index import with_row_index
        return with_row_index(df, key, out, partition_by, tie_break)
    return number_rows(df, [key], out, partition_by, tie_break)
