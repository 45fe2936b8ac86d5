"""Periodic runs of words by internal pattern matching.

A run of smallest period q and at least four periods holds, for the power of
two B with q <= B < 2q, a whole aligned (dyadic) block of B words, and the
block comes again exactly q words later or earlier inside the run: the block is
at least a period long, so its occurrences there are an arithmetic progression
of step q. So each block asks for its nearest occurrence in the window of B
words on either side; the distance is a candidate period, and comparing both
ways from there gives the run or refutes it. Every block of every size asks, so
no run is missed; what is found is verified, so none is wrong.

The occurrences of a block are one interval of the text's suffix array. Names
by prefix doubling (the interval's first place for the 1, 2, 4, ... words from
each place on) give the intervals, the sorted suffixes, and the comparisons; a
wavelet matrix over the suffix array answers the successor and predecessor of a
place within an interval. Blocks of one word need no index: their window is the
next word.

Work is done on bundles of rows of bounded size; suffixes are sorted by row
first, so rows never meet.

Defined results: null and empty texts have no words and no runs; texts under six
words have no runs; very long texts are handled whole; repeated rows are rows of
their own; an empty table gives an empty frame; other columns are carried only
if asked for, and clashing names are told by an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceflow.llm.common import words_array
from stanceflow.llm.wordarrays import Wavelet, bundles, numbered, starts_of

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4

#: Bytes of text in a bundle.
BUNDLE_BYTES = 2_000_000

RUN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "length", "period")])


class Suffixes:
    """Suffixes of many rows, sorted by row first.

    names[k][i]: first place, in sorted order, of the suffixes that share the
    2^k words from place i on with it (equal names: equal words; the end of a
    row counts as a word of its own). live[k]: the places whose name is shared,
    in sorted order. order: the suffix array."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        n = len(ids)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        end = offsets[1:][row]
        key = row << 32 | ids
        self.order = np.argsort(key)
        first = np.ones(n, bool)
        first[1:] = np.diff(key[self.order]) != 0
        place = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        name = np.empty(n, np.int32)
        name[self.order] = place
        self.names = [name]
        shared = ~first
        shared[:-1] |= ~first[1:]
        self.live = [self.order[shared]]
        slots = np.flatnonzero(shared)  # the places in the order of what is shared
        step = 1
        while len(slots):
            at = self.order[slots]
            old = self.names[-1]
            head, nxt = old[at].astype(np.int64), at + step
            inside = nxt < end[at]
            tail = np.where(inside, old[np.minimum(nxt, n - 1)].astype(np.int64) + 1, 0)
            key = head << 32 | tail
            by = np.argsort(key)
            key, at = key[by], at[by]
            self.order[slots] = at  # the sort keeps each interval in its slots
            first = np.ones(len(key), bool)
            first[1:] = np.diff(key) != 0
            place = slots[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            name = old.copy()
            name[at] = place
            self.names.append(name)
            shared = ~first
            shared[:-1] |= ~first[1:]
            slots = slots[shared]
            self.live.append(self.order[slots])
            step *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places a < b on are equal."""
        n, far = len(self.order), b.copy()
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            same = (far < n) & (name[np.minimum(far - b + a, n - 1)] == name[np.minimum(far, n - 1)])
            far = far + (same.astype(np.int64) << k)
        return far - b

    def backward(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words before places a < b are equal, in rows from ``begin`` on."""
        low = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            name, to = self.names[k], low - (1 << k)
            same = (to >= begin) & (name[np.maximum(to, 0)] == name[np.maximum(to + b - a, 0)])
            low = np.where(same, to, low)
        return a - low


def runs_of(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of all rows, by start, then period."""
    rows = np.diff(offsets)
    begin = np.repeat(offsets[:-1], rows)
    end = np.repeat(offsets[1:], rows)
    found = [_single(ids, begin)]
    suffixes = Suffixes(ids, offsets)
    if len(suffixes.live) > 1 and len(suffixes.live[1]):
        found += _longer(suffixes, begin, end, int(rows.max()))
    start, stop, period = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((period, stop, start))
    start, stop, period = start[by], stop[by], period[by]
    fresh = np.ones(len(start), bool)  # of one stretch the smallest period stays
    fresh[1:] = (np.diff(start) != 0) | (np.diff(stop) != 0)
    start, stop, period = start[fresh], stop[fresh], period[fresh]
    by = np.lexsort((period, start))
    return start[by], (stop - start)[by], period[by]


def _single(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one word, as (start, stop, period)."""
    n = len(ids)
    fresh = np.ones(n, bool)
    fresh[1:] = (np.diff(ids) != 0) | (begin[1:] == np.arange(1, n))
    start = np.flatnonzero(fresh)
    stop = np.append(start[1:], n) if n else start
    good = stop - start >= max(LEAST_WORDS, LEAST_PERIODS)
    return start[good], stop[good], np.ones(int(good.sum()), np.int64)


def _longer(suffixes: Suffixes, begin: np.ndarray, end: np.ndarray, longest: int) -> list:
    """Runs of period two and more, as (start, stop, period) parts per block size."""
    # Only suffixes that share two words are asked for: the matrix holds these.
    kept = np.zeros(len(begin), bool)
    kept[suffixes.live[1]] = True
    kept = kept[suffixes.order]
    slot = np.concatenate(([0], np.cumsum(kept)))
    values = suffixes.order[kept]
    matrix = Wavelet.of(values - begin[values], max(1, (longest - 1).bit_length()))
    parts = []
    for k in range(1, len(suffixes.names)):
        size, name, live = 1 << k, suffixes.names[k], suffixes.live[k]
        if not len(live):
            break
        heads = name[live]
        first = np.flatnonzero(np.concatenate(([True], np.diff(heads) != 0)))
        length = np.repeat(np.diff(np.append(first, len(live))), np.diff(np.append(first, len(live))))
        block = ((live - begin[live]) % size == 0) & (live + size <= end[live])
        at, lo = live[block], slot[heads[block]]
        hi, here = lo + length[block], at - begin[at]
        before = matrix.smaller(lo, hi, here)
        for side in (1, -1):
            rank = before + side
            there = (rank >= 0) & (rank < hi - lo)
            other = matrix.kth(lo[there], hi[there], rank[there])
            gap = side * (other - here[there])
            near = gap <= size
            a = np.minimum(at[there], at[there] + side * gap)[near]
            parts.append(_verified(suffixes, a, a + gap[near], begin))
    return parts


def _verified(suffixes: Suffixes, a: np.ndarray, b: np.ndarray, begin: np.ndarray):
    start = a - suffixes.backward(a, b, begin[a])
    stop = b + suffixes.forward(a, b)
    good = stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * (b - a))
    return start[good], stop[good], (b - a)[good]


def _repeated(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def find_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
              bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """``keep`` columns + n_words (long), runs (array<struct<start, length,
    period>>, words from 0, by start, then period) and collapsed (the words
    that no run holds after its first period, joined by one space)."""
    made = ("n_words", "runs", "collapsed")
    if {c.lower() for c in keep} & set(made):
        raise ValueError(f"columns to keep clash with {made}")
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    n = len(keep)

    def run(batches):
        for batch in bundles(batches, n, bundle_bytes):
            ids, counts, vocabulary = numbered(batch.column(n))
            offsets = starts_of(counts)
            start, length, period = runs_of(ids, offsets)
            owner = np.searchsorted(offsets, start, side="right") - 1
            lists = starts_of(np.bincount(owner, minlength=len(counts)))
            parts = [pa.array(x.astype(np.int32)) for x in (start - offsets[owner], length, period)]
            stays = ~_repeated(len(ids), start, length, period)
            kept = starts_of(stays)[offsets]
            words = vocabulary.take(pa.array(ids[stays]))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), words), " ")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(counts),
                 pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)),
                                          pa.StructArray.from_arrays(parts, names=["start", "length", "period"])),
                 joined], names=[*batch.schema.names[:n], *made])

    return docs.select(*keep, text).mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period (ties: the first)."""
    def better(acc, r):
        more = r["length"].cast("long") * acc["period"] > acc["length"].cast("long") * r["period"]
        return F.when(acc.isNull() | more, r).otherwise(acc)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def with_planted_periods(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's input: where h = crc32(key) is divisible by ten, words from
    place a on repeat the first p of them; all other texts stay as they are."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = docs.withColumn("_w", F.when(h % 10 == 0, words_array(F.coalesce(F.col(text), F.lit("")))))
    n, w = F.size("_w"), F.col("_w")
    shaped = words.withColumn("_a", F.when(n > 0, (g % n).cast("int")))
    a = F.col("_a")
    shaped = shaped.withColumn("_p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    p = F.col("_p")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
    new = F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")
    return shaped.withColumn(text, F.when(a.isNotNull(), new).otherwise(F.col(text))).drop("_w", "_a", "_p")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of runs, the strongest one, hashes of all runs and
    of the collapsed text, on the input with planted periods."""
    found = find_runs(with_planted_periods(docs.select(key, text), key, text), (key,), text)
    found = found.withColumn("_best", strongest(F.col("runs")))
    best = F.col("_best")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                      r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        key, F.size("runs").cast("long").alias("n_runs"), best["start"].cast("long").alias("start"),
        best["length"].cast("long").alias("length"), best["period"].cast("long").alias("period"),
        F.floor(1000 * best["length"].cast("long") / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
