"""Benchmark decontamination by an FM-index per training shard.

A shard is a bounded run of documents. Its index is one row of a Parquet table:
the shard's words, the wavelet matrix of its Burrows-Wheeler transform, and
sampled suffix positions (every ``SAMPLE``-th word and each document's first).
The table is built once; any number of test sets can be searched in it later.

Test items are cut into windows of ten words (an item of fewer is one window).
The distinct windows form blocks of bounded size, and each block meets each
shard: backward search narrows the rows of the index word by word from a
window's last to its first, by two wavelet ranks a step; the rows that remain
are its occurrences, located by walking back to the next sampled position. Their
places are merged into the spans to remove, document by document.

Windows that no shard's vocabulary covers end at once; all others are searched
exactly, so nothing is missed and nothing else is hit. What a block finds is
(shard, document) rows; these meet the document list and, by window number, the
test items in plain joins.

Defined results: null and empty texts have no words, are never hit and are in no
item's windows; an item without words is no item; items of one id count as one,
and an item without an id hits words but is not counted; repeated documents are
rows of their own; very long texts are one shard; empty tables give no hits;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceflow.llm.common import Shared, staged
from stanceflow.llm.wordarrays import LETTERS, Wavelet, bundles, numbered, packed, spread, starts_of

#: Words in a window.
WINDOW = 10
#: Bytes of text in a shard.
SHARD_BYTES = 4_000_000
#: Every so many words the index keeps a suffix position.
SAMPLE = 8
#: Bytes of distinct windows in a block, which is sent to all workers.
BLOCK_BYTES = 8_000_000
#: Occurrences of a block that are located at a time in one shard.
CHUNK = 1 << 20

BLOB, INT, LONG = T.BinaryType(), T.IntegerType(), T.LongType()


def sorted_suffixes(text: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Suffix array of word numbers (from 1) with separators (0), each of which
    is smaller than all words, and than the separators after it."""
    n = len(text)
    symbols = text.astype(np.int64) + len(separators)
    symbols[separators] = np.arange(len(separators))
    width = max(1, int(symbols.max()).bit_length())
    depth = max(1, min(4, 62 // width))
    key = symbols.copy()
    for k in range(1, depth):
        key <<= width
        key[:n - k] |= symbols[k:]
    order = np.argsort(key)
    first = np.ones(n, bool)
    first[1:] = np.diff(key[order]) != 0
    place = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    name = np.empty(n, np.int64)
    name[order] = place
    shared = ~first
    shared[:-1] |= ~first[1:]
    slots = np.flatnonzero(shared)
    # A shared prefix may reach over a separator only if both are the same one,
    # which cannot be: so what is still shared has its next words in the text.
    while len(slots):
        at = order[slots]
        key = name[at] << 32 | name[at + depth]
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[slots] = at
        first = np.ones(len(key), bool)
        first[1:] = np.diff(key) != 0
        name[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        shared = ~first
        shared[:-1] |= ~first[1:]
        slots = slots[shared]
        depth *= 2
    return order


PARTS = ("words", "bits", "marks", "samples", "word_rows", "starts")


def packed_index(ids: np.ndarray, counts: np.ndarray, words: pa.Array) -> dict[str, bytes]:
    """The FM-index of one shard as bytes."""
    starts = starts_of(counts + 1)  # with a separator after each document
    text = np.zeros(starts[-1], np.int32)
    text[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids + 1
    order = sorted_suffixes(text, starts[1:] - 1)
    keep = np.arange(len(text)) % SAMPLE == 0
    keep[starts[:-1]] = True
    marked = keep[order]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0]
    return {"words": joined.as_py().encode(), "bits": packed(text[order - 1], len(words).bit_length()),
            "marks": np.packbits(marked).tobytes(), "samples": order[marked].astype("<i4").tobytes(),
            "word_rows": np.bincount(text, minlength=len(words) + 1).astype("<i4").tobytes(),
            "starts": starts.astype("<i8").tobytes()}


class Index:
    """The FM-index of one shard, from its bytes. Words are numbered from 1;
    separators are 0. first_row: the first row of each number's suffixes;
    starts: where each document starts (the total last)."""

    def __init__(self, row: dict[str, bytes]):
        self.words = pa.array(row["words"].decode().split(" ") if row["words"] else [], pa.string())
        self.starts = np.frombuffer(row["starts"], "<i8")
        n = int(self.starts[-1])
        self.matrix = Wavelet.unpacked(row["bits"], n, len(self.words).bit_length())
        self.marked = starts_of(np.unpackbits(np.frombuffer(row["marks"], np.uint8), count=n))
        self.samples = np.frombuffer(row["samples"], "<i4")
        self.first_row = starts_of(np.frombuffer(row["word_rows"], "<i4"))
        every = np.arange(len(self.words) + 1)
        # a word's first row, less the place where the matrix starts counting it
        self.shift = self.first_row[:-1] - self.matrix.follow(every, np.zeros_like(every))

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first row, row after the last) of the windows that occur.
        ``windows``: word numbers from 1, right-aligned; 0 before a shorter
        window's first word, -1 for a word that is not in the shard."""
        which = np.flatnonzero((windows >= 0).all(axis=1) & (windows[:, -1] > 0))
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.matrix.n, np.int64)
        done = []
        for step in range(windows.shape[1] - 1, -1, -1):
            word = windows[which, step]
            over = word == 0  # a shorter window is through
            done.append((which[over], lo[over], hi[over]))
            which, lo, hi, word = which[~over], lo[~over], hi[~over], word[~over]
            lo, hi = self.matrix.follow(word, lo) + self.shift[word], self.matrix.follow(word, hi) + self.shift[word]
            some = lo < hi
            which, lo, hi = which[some], lo[some], hi[some]
        done.append((which, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text place of each row's suffix."""
        place = np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            before = self.marked[rows]
            sampled = self.marked[rows + 1] > before
            place[todo[sampled]] = self.samples[before[sampled]] + steps
            todo, rows = todo[~sampled], rows[~sampled]
            word, at = self.matrix.access(rows)
            rows = at + self.shift[word]
            steps += 1
        return place


def index(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
          shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard: shard (a name), docs (array of structs: the ``keep``
    columns and n_words of each document, in order) and the packed index."""
    if "n_words" in {c.lower() for c in keep}:
        raise ValueError("a column to keep is named n_words")
    doc = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_words", LONG)])
    schema = T.StructType([T.StructField("docs", T.ArrayType(doc)), *[T.StructField(p, BLOB) for p in PARTS]])
    n = len(keep)

    def run(batches):
        for batch in bundles(batches, n, shard_bytes):
            ids, counts, words = numbered(batch.column(n), LETTERS)
            made = packed_index(ids, counts, words)
            rows = pa.StructArray.from_arrays([*batch.columns[:n], pa.array(counts)],
                                              names=[*batch.schema.names[:n], "n_words"])
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                 *[pa.array([made[p]], pa.binary()) for p in PARTS]], names=["docs", *PARTS])

    return docs.select(*keep, text).mapInArrow(run, schema).withColumn("shard", F.monotonically_increasing_id())


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (window, item): the space-joined words of each window."""
    schema = T.StructType([T.StructField("window", T.StringType()), T.StructField("item", items.schema[item].dataType)])

    def run(batches):
        for batch in bundles(batches, 1, SHARD_BYTES):
            ids, counts, words = numbered(batch.column(1), LETTERS)
            size = np.minimum(counts, window)
            many = np.where(counts > 0, counts - size + 1, 0)
            first = np.repeat(starts_of(counts)[:-1], many) + spread(many)
            size = np.repeat(size, many)
            at = np.repeat(first, size) + spread(size)
            lists = pa.ListArray.from_arrays(pa.array(starts_of(size).astype(np.int32)),
                                             words.take(pa.array(ids[at])))
            owner = np.repeat(np.arange(len(counts)), many)
            yield pa.RecordBatch.from_arrays([pc.binary_join(lists, " "), batch.column(0).take(pa.array(owner))],
                                             names=["window", "item"])

    return items.select(item, text).mapInArrow(run, schema).distinct()


class Block:
    """Windows of one block as word numbers of the block's own vocabulary."""

    def __init__(self, numbers: np.ndarray, windows: list[str], window: int):
        split = [w.split(" ") for w in windows]
        self.words = sorted({w for ws in split for w in ws})
        known = {w: i + 1 for i, w in enumerate(self.words)}
        self.numbers = numbers
        self.sizes = np.array([len(ws) for ws in split], np.int64)
        self.codes = np.zeros((len(split), window), np.int64)
        for i, ws in enumerate(split):
            self.codes[i, window - len(ws):] = [known[w] for w in ws]

    def for_shard(self, words: pa.Array) -> np.ndarray:
        """The windows in a shard's word numbers (-1: not there)."""
        found = pc.index_in(pa.array(self.words, pa.string()), value_set=words)
        own = pc.fill_null(found, -2).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        return np.concatenate(([0], own))[self.codes]


def _hits(index_: Index, block: Block):
    """(document, window) pairs without repeats, and the merged hit spans as
    (document, start, end) in words of the document."""
    which, lo, hi = index_.search(block.for_shard(index_.words))
    edge = np.zeros(index_.matrix.n + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    many = hi - lo
    ends = np.cumsum(many)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
        place = np.arange(begin, min(begin + CHUNK, int(ends[-1])))
        owner = np.searchsorted(ends, place, side="right")
        at = index_.locate(hi[owner] - (ends[owner] - place))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + block.sizes[which[owner]], -1)
        doc = np.searchsorted(index_.starts, at, side="right") - 1
        pairs.append(np.unique(doc * len(block.sizes) + which[owner]))
    pair = np.unique(np.concatenate(pairs))
    hit = np.cumsum(edge) > 0  # the place after the last word is never hit
    turn = np.diff(np.concatenate(([False], hit)).astype(np.int8))
    start, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    doc = np.searchsorted(index_.starts, start, side="right") - 1
    size = max(1, len(block.sizes))
    return (pair // size, block.numbers[pair % size]), (doc, start - index_.starts[doc], stop - index_.starts[doc])


SPANS = T.ArrayType(T.StructType([T.StructField("start", LONG), T.StructField("end", LONG)]))


def search(shards: DataFrame, block: Shared) -> DataFrame:
    """Rows (shard, at, windows, spans) for the documents (the at-th of a shard)
    that some window of the block hits; windows are their numbers."""
    schema = T.StructType([T.StructField("shard", LONG), T.StructField("at", INT),
                           T.StructField("windows", T.ArrayType(LONG)), T.StructField("spans", SPANS)])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {p: batch.column(p)[i].as_py() for p in PARTS}
                (doc, number), (owner, start, end) = _hits(Index(row), block())
                hit = np.unique(doc)
                lists = np.searchsorted(doc, np.append(hit, len(row["starts"])))
                spans = np.searchsorted(owner, np.append(hit, len(row["starts"])))
                both = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hit), batch.column("shard")[i].as_py())), pa.array(hit.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(number)),
                     pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), both)],
                    names=["shard", "at", "windows", "spans"])

    return shards.select("shard", *PARTS).mapInArrow(run, schema)


def numbered_windows(windows: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Distinct windows as (block, number, window), and the number of blocks,
    which is chosen by the windows' bytes."""
    distinct = windows.select("window").distinct()
    total = distinct.agg(F.sum(F.octet_length("window") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // (block_bytes // 2)))  # by hash: half full on average
    cut = distinct.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("int"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("window"))
    return staged(cut.withColumn("number", F.shiftleft(F.col("block").cast("long"), 32) + place), "windows"), blocks


def merged(spans: Column) -> Column:
    """Spans of several blocks as their union: sorted, overlapping or touching ones joined."""
    def step(acc, s):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)) >= s["start"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))) \
            .otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def decontaminate(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                  item: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``keep`` columns, n_words, spans (merged word spans to
    remove, [start, end)), items (sorted distinct ids, as text, of the items
    with an occurring window)."""
    windows = staged(item_windows(items, item, item_text, window), "item-windows")
    numbers, blocks = numbered_windows(windows, block_bytes)
    shards = staged(index(docs, keep, text, shard_bytes), "fm-index")
    return found(shards, windows, numbers, blocks, window)


def found(shards: DataFrame, windows: DataFrame, numbers: DataFrame, blocks: int, window: int = WINDOW) -> DataFrame:
    """``decontaminate``'s rows from an index table and numbered windows."""
    spark = shards.sparkSession
    parts = []
    for b in range(blocks):  # each block's windows have a bounded size
        rows = numbers.where(F.col("block") == b).select("number", "window").toArrow()
        block = Block(rows["number"].to_numpy(), rows["window"].to_pylist(), window)
        parts.append(staged(search(shards, Shared(spark, block)), "hits"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    if blocks > 1:
        spans = hits.groupBy("shard", "at").agg(F.flatten(F.collect_list("spans")).alias("spans")) \
            .withColumn("spans", merged(F.col("spans")))
    else:
        spans = hits.select("shard", "at", "spans")
    named = windows.where(F.col("item").isNotNull()).join(numbers.select("number", "window"), "window")
    items = hits.select("shard", "at", F.explode("windows").alias("number")) \
        .join(named.select("number", "item"), "number") \
        .groupBy("shard", "at").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    base = shards.select("shard", F.posexplode("docs").alias("at", "doc")).select("shard", "at", "doc.*")
    return (base.join(spans, ["shard", "at"], "left").join(items, ["shard", "at"], "left")
            .withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
            .withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).drop("shard", "at"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: words, hit words, items and their hash, the verdict."""
    rows = decontaminate(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                       (n_hit > 0).alias("contaminated"))
