"""Token files coded by a static range asymmetric numeral system (rANS).

One table of symbol frequencies, counted over the whole corpus and scaled to
2^``BITS``, is shared by all blocks. A block holds whole documents in key order
and is coded on its own by ``LANES`` interleaved coders, so blocks are read in
any order and a block's lanes advance together as vectors. Every
``CHECKPOINT`` rounds the block notes its place in the stream, all lane states
and a CRC-32 of the ids up to the next checkpoint, so that reading can start
and be checked there.

A block's bytes (integers little-endian):

    magic "RTB2" | u32 documents, symbols, lanes, rounds between checkpoints,
    checkpoints, stream words | u32 crc32 of the document list | documents x
    (i64 key, u8 has key, u32 ids) | checkpoints x (u32 stream place, u32 crc32
    of the segment's ids, lanes x u64 state) | stream words x u32

Lane l codes the symbols l, l + LANES, ... of the block. States are 64 bits,
kept in [2^31, 2^63) by 32-bit words.

A token file is a folder. ``blocks`` is a Parquet table of rows (part, block,
counts, smallest and largest key, payload) in ascending key order, so that
Spark's commit protocol covers them: a lost task leaves no half-written block.
``header``, written last, is one row with all that reading needs: version,
digest of the tokenizer file, number of symbols, end id, ids in all, and the
frequency table. A folder without it is unfinished and is not read.

Defined results: a null text is an empty document (its end id alone); rows
without a key come first, repeated keys follow each other in an order fixed by
a hash of their ids; a document longer than ``BLOCK_SYMBOLS`` is a block of its own; an
empty table gives an empty file; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from stanceflow.llm.common import Shared, cached, release_memory, scratch_path, staged

BITS = 18
LANES = 2048
BLOCK_SYMBOLS = 1 << 20
CHECKPOINT = 256
LOW = 1 << 31
MAGIC = b"RTB2"
VERSION = 2

#: Most ids that one task sorts and codes, on average; the number of parts
#: follows from the corpus's ids.
PART_IDS = 1 << 26


# ---- tokenizing with the tokenizers library

class Tokens:
    """Ids by the library, piece by piece. Byte-level files cut a text before
    every single space and line end, so each distinct piece is encoded once
    while it stays in the worker's table. The table has a young and an old
    half: when the young one is full it becomes the old one, and pieces still
    in use move back."""

    def __init__(self, data: bytes, width: str = "<u4"):
        self.width = width
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # words get here once, so the library's own table of words only costs time
        resize = getattr(self.tokenizer.model, "_resize_cache", None)
        if resize is not None:
            resize(0)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # a line end of one token can separate the pieces of one call
        end = self.library("\n")
        self.line_end = end[0] if len(end) == 1 else None
        self.single = end.tobytes()
        # the byte-level pattern cuts letters from a mark: a piece that ends in
        # one has the ids of its word and of the mark
        cut = json.loads(data).get("pre_tokenizer") or {}
        by_pattern = cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
        self.marks = {m: self.library(m).tobytes() for m in MARKS} if by_pattern else {}
        # and before every space: the tokens that stand at a piece's start are
        # those with a space in front (U+0120 there) and the line end
        self.starts = None
        if by_pattern and self.line_end is not None:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.starts = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.starts[[i for s, i in vocab.items() if s[0] == "\u0120"] + [self.line_end]] = True

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids,
                        dtype=self.width)

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces; a word with a mark is put together from the two."""
        young, marks = self.young, self.marks
        marked = [p for p in pieces if p[-1:] in marks and WORD(p, 0, len(p) - 1)]
        if marked:
            self.learn_whole(list({p[:-1] for p in marked}.union(pieces).difference(marked, young)))
            young.update([(p, young[p[:-1]] + marks[p[-1]]) for p in marked])
        else:
            self.learn_whole(pieces)

    def learn_whole(self, pieces: list[str]) -> None:
        """Encode pieces, many in one call: each starts with its space or line
        end there. Without the byte-level pattern a line end goes before each,
        which is part of a piece only if it is its own."""
        self.young["\n"] = self.single  # beside another one it would not stand alone
        pieces = [p for p in pieces if p != "\n"]
        own = self.starts is not None
        before = " " if own else "\n "
        for at in range(0, len(pieces), JOINED):
            part = pieces[at:at + JOINED]
            ids = self.library("".join([p if p[:1] == "\n" else before + p for p in part]))
            size = ids.itemsize
            starts = (size * np.flatnonzero(self.starts[ids] if own else ids == self.line_end)).tolist()
            if len(starts) != len(part):
                raise ValueError("the tokenizer joins line ends with other text")
            data = ids.tobytes()
            ends = [*starts[1:], len(data)]
            if own:
                found = [data[a:b] for a, b in zip(starts, ends, strict=True)]
            else:
                found = [data[a if p[:1] == "\n" else a + size:b] for p, a, b in zip(part, starts, ends, strict=True)]
            self.young.update(zip(part, found, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of the table's width."""
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> pa.Array:
        """The same for a column, each text followed by ``end_id``. Texts are
        cut and their pieces numbered as columns, so that the table is asked
        once for each distinct piece."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.line_end is None:
            return self.encode_whole(texts, end_id)
        odd = pc.match_substring_regex(texts, IRREGULAR)
        if not pc.any(odd).as_py():
            return self.encode_pieces(texts, end_id)
        odd = odd.to_numpy(zero_copy_only=False)
        both = pa.concat_arrays([self.encode_pieces(texts.filter(pa.array(~odd)), end_id),
                                 self.encode_whole(texts.filter(pa.array(odd)), end_id)])
        return both.take(pa.array(np.argsort(np.argsort(odd, kind="stable"))))

    def encode_whole(self, texts: pa.Array, end_id: int | None) -> pa.Array:
        tail = b"" if end_id is None else np.array([end_id], dtype=self.width).tobytes()
        return pa.array([self.library(t).tobytes() + tail for t in texts.to_pylist()], pa.binary())

    def encode_pieces(self, texts: pa.Array, end_id: int | None) -> pa.Array:
        if len(self.young) > HALF_TABLE:
            self.old, self.young = self.young, {}
        # a piece "w" stands for " w", a piece "\nw" for itself; the first word
        # borrows a line end, which is dropped again below
        parts = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        coded = parts.flatten().dictionary_encode()
        here = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        young, old = self.young, self.old
        new = [p for p in here if p not in young]
        young.update([(p, old[p]) for p in new if p in old])
        self.learn([p for p in new if p not in old])
        found = list(map(young.__getitem__, here))
        offsets, data = binary_parts(binary_array(np.fromiter(map(len, found), np.int64, len(found)), b"".join(found))
                                     .take(coded.indices))
        flat = data.view(self.width)
        cuts = offsets[parts.offsets.to_numpy()] // flat.itemsize  # places of the borrowed line ends, and the end
        if end_id is None:
            flat, cuts = np.delete(flat, cuts[:-1]), cuts - np.arange(len(cuts))
        else:  # the next text's line end gives its place to the end
            flat = np.append(flat, flat.dtype.type(end_id))
            flat[cuts] = end_id
            flat = flat[1:]
        return binary_array(np.diff(cuts) * flat.itemsize, np.ascontiguousarray(flat))


#: Marks that end a word of Latin letters.
MARKS = ".,;:!?"
WORD = re.compile(r"\n?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch

#: Pieces in each half of a worker's table, and in one call of the library.
HALF_TABLE = 400_000
JOINED = 1_000

#: Bytes of text handled at a time.
TEXT_RUN = 16_000_000

#: Text with white space that is not one space or line end between other
#: characters, or with a special string's bracket: the library gets it whole.
IRREGULAR = (r"\A[ \n]|[ \n]\z|[ \n][ \n]|<\||[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
             r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def binary_array(sizes: np.ndarray, data) -> pa.Array:
    """Binary values of these sizes that follow each other in ``data``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] >= 1 << 31:
        raise OverflowError("over 2 GB of ids in one run of texts")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a binary column without nulls."""
    if not len(column):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset)
    low, high = int(offsets[0]), int(offsets[-1])
    return offsets - low, np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)


def runs(column: pa.Array, most: int = TEXT_RUN) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in runs of at most ``most`` bytes or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, column.slice(at, stop - at)
        at = stop


def tokenize(docs: DataFrame, path: str, key: str, text: str, end_id: int | None) -> DataFrame:
    """(doc_key, ids): ids as binary, two bytes each if the vocabulary allows."""
    with open(path, "rb") as f:
        data = f.read()
    tables = docs.sparkSession.sparkContext.broadcast(data)  # the vocabulary file: its size is fixed
    width = id_width(Tokenizer.from_buffer(data).get_vocab_size(with_added_tokens=True))
    schema = T.StructType([T.StructField("doc_key", T.LongType()), T.StructField("ids", T.BinaryType())])
    name = ("tokens", zlib.crc32(data), len(data))

    def run(batches):
        tokens = cached(name, lambda: Tokens(tables.value, width))
        for batch in batches:
            for at, texts in runs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)),
                                                  tokens.encode_column(texts, end_id)], names=["doc_key", "ids"])
        release_memory()

    return docs.select(F.col(key).cast("long").alias("doc_key"), text).mapInArrow(run, schema)


def id_width(symbols: int) -> str:
    return "<u2" if symbols <= 1 << 16 else "<u4"


def count_ids(tokens: DataFrame, symbols: int) -> DataFrame:
    """(id, n) over all documents; each task adds up a vector first."""
    width = id_width(symbols)

    def run(batches):
        total = np.zeros(symbols, dtype=np.int64)
        for batch in batches:
            _, ids = binary_parts(batch.column(0).cast(pa.binary()))
            total += np.bincount(ids.view(width), minlength=symbols)
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())],
                                         names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# ---- the coder

class Table:
    """Frequencies scaled to 2^BITS, at least 1 for every symbol that occurs."""

    def __init__(self, counts: np.ndarray, bits: int = BITS):
        counts = np.asarray(counts, dtype=np.int64)
        used = np.nonzero(counts)[0]
        if len(used) > 1 << bits:
            raise ValueError("more symbols than slots")
        freq = np.zeros(len(counts), dtype=np.int64)
        if len(used):
            share = counts[used] * ((1 << bits) / counts[used].sum())
            freq[used] = np.maximum(1, np.floor(share)).astype(np.int64)
            # the rest goes to, or comes from, the most frequent symbols
            order = used[np.lexsort((used, -freq[used]))]
            gap = (1 << bits) - int(freq.sum())
            if gap > 0:
                freq[order[0]] += gap
            i = 0
            while gap < 0:
                cut = min(-gap, max(0, int(freq[order[i]]) // 2))
                freq[order[i]] -= cut
                gap += cut
                i = (i + 1) % len(order)
        self.bits = bits
        self._fill(freq)

    @classmethod
    def of(cls, freq: np.ndarray, bits: int) -> Table:
        """The table with these scaled frequencies, as kept in a header."""
        table = cls.__new__(cls)
        table.__setstate__({"bits": bits, "freq": np.asarray(freq, dtype=np.int64)})
        return table

    def _fill(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        # by slot, so that a decoding step is one look-up
        self.slot_freq = np.repeat(freq, freq).astype(np.uint32)
        self.slot_rest = (np.arange(len(self.symbol)) - np.repeat(self.start.astype(np.int64), freq)).astype(np.uint32)

    def __getstate__(self):
        return {"bits": self.bits, "freq": self.freq}

    def __setstate__(self, state):
        self.bits = state["bits"]
        self._fill(state["freq"].astype(np.int64))


def encode_stream(ids: np.ndarray, table: Table, lanes: int = LANES,
                  every: int = CHECKPOINT) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(stream of 32-bit words in reading order, checkpoints). Checkpoint c is
    the reader's place and lane states before round c * every."""
    rounds = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    f_all, s_all = table.freq[ids], table.start[ids]
    shift = np.uint64(63 - table.bits)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for r in range(rounds - 1, -1, -1):
        f, s = f_all[r * lanes:(r + 1) * lanes], s_all[r * lanes:(r + 1) * lanes]
        n = len(f)
        x = state[:n]
        # renormalise: states stay in [2^31, 2^63) around each step
        big = x >= (f << shift)
        out = x[big]
        if len(out):
            words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
            written += len(out)
            x = np.where(big, x >> np.uint64(32), x)
        q = x // f
        state[:n] = (q << np.uint64(table.bits)) + (x - q * f) + s
        if r % every == 0:
            marks.append((written, state.astype("<u8")))
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, dtype="<u4")
    return stream, [(written - w, st) for w, st in reversed(marks)]


def decode_stream(stream: np.ndarray, marks: list[tuple[int, np.ndarray]], n: int, table: Table, lanes: int,
                  every: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the rounds from checkpoint ``first`` up to checkpoint ``last``
    (default: to the end)."""
    rounds = -(-n // lanes)
    stop = rounds if last is None else min(rounds, last * every)
    out = np.empty(min(n, stop * lanes) - first * every * lanes, dtype=np.uint32)
    place, state = marks[first][0], marks[first][1].astype(np.uint64)
    mask, bits = np.uint64((1 << table.bits) - 1), np.uint64(table.bits)
    at = 0
    for r in range(first * every, stop):
        m = min(lanes, n - r * lanes)
        x = state[:m]
        slot = (x & mask).astype(np.int64)
        out[at:at + m] = table.symbol[slot]
        at += m
        x = table.slot_freq[slot] * (x >> bits) + table.slot_rest[slot]
        low = x < LOW
        k = int(np.count_nonzero(low))
        if k:
            if place + k > len(stream):
                raise ValueError("a token block is damaged: its stream ends before the checksum")
            x[low] = (x[low] << np.uint64(32)) | stream[place:place + k]
            place += k
        state[:m] = x
    return out


# ---- blocks

def pack_block(keys: list[int | None], sizes: list[int], ids: np.ndarray, table: Table, lanes: int = LANES,
               every: int = CHECKPOINT) -> bytes:
    stream, marks = encode_stream(ids, table, lanes, every) if len(ids) else (np.zeros(0, "<u4"), [])
    docs = b"".join(struct.pack("<qBI", k or 0, k is not None, s) for k, s in zip(keys, sizes, strict=True))
    head = struct.pack("<4s7I", MAGIC, len(keys), len(ids), lanes, every, len(marks), len(stream), zlib.crc32(docs))
    span = lanes * every
    crcs = [segment_crc(ids[at:at + span]) for at in range(0, len(ids), span)]
    return head + docs + b"".join(struct.pack("<2I", w, c) + st.tobytes()
                                  for (w, st), c in zip(marks, crcs, strict=True)) + stream.tobytes()


def segment_crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Block:
    """A block's document list and, by need, its ids."""

    def __init__(self, data: bytes):
        magic, n_docs, self.n, self.lanes, self.every, n_marks, n_words, crc = struct.unpack_from("<4s7I", data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = struct.calcsize("<4s7I")
        listed = data[at:at + 13 * n_docs]
        if zlib.crc32(listed) != crc:
            raise ValueError("a token block's checksum differs (document list)")
        docs = list(struct.iter_unpack("<qBI", listed))
        self.keys = [k if has else None for k, has, _ in docs]
        self.sizes = np.array([s for _, _, s in docs], dtype=np.int64)
        at += 13 * n_docs
        self.marks, self.crcs = [], []
        for _ in range(n_marks):
            place, crc = struct.unpack_from("<2I", data, at)
            self.marks.append((place, np.frombuffer(data, "<u8", self.lanes, at + 8)))
            self.crcs.append(crc)
            at += 8 + 8 * self.lanes
        self.stream = np.frombuffer(data, "<u4", n_words, at)

    def ids(self, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids at the places ``first`` up to ``last`` (exclusive) of the block.
        Decoding starts at the checkpoint before and ends at the one after; the
        checksum of each segment in between is held."""
        last = self.n if last is None else min(last, self.n)
        if last <= first:
            return np.zeros(0, np.uint32)
        span = self.lanes * self.every
        low, high = first // span, -(-last // span)
        ids = decode_stream(self.stream, self.marks, self.n, table, self.lanes, self.every, low, high)
        for c in range(low, high):
            if segment_crc(ids[(c - low) * span:(c - low + 1) * span]) != self.crcs[c]:
                raise ValueError("a token block's checksum differs")
        return ids[first - low * span:last - low * span]

    def between(self, low: int | None, high: int | None) -> tuple[int, int]:
        """The documents (first, end) whose keys lie in [low, high]; with a
        bound given, documents without a key are outside."""
        if low is None and high is None:
            return 0, len(self.keys)
        inside = [i for i, k in enumerate(self.keys)
                  if k is not None and (low is None or k >= low) and (high is None or k <= high)]
        return (inside[0], inside[-1] + 1) if inside else (0, 0)


def unpack_block(data: bytes, table: Table) -> tuple[list[int | None], list[np.ndarray]]:
    """(keys, ids of each document); the checksums are held."""
    block = Block(data)
    ends = np.cumsum(block.sizes)
    return block.keys, np.split(block.ids(table), ends[:-1]) if block.keys else []


def blocks_of(rows: Iterable[tuple[int | None, np.ndarray]],
              most: int = BLOCK_SYMBOLS) -> Iterator[tuple[list[int | None], list[int], np.ndarray]]:
    keys: list[int | None] = []
    parts: list[np.ndarray] = []
    size = 0
    for key, ids in rows:
        if keys and size + len(ids) > most:
            yield keys, [len(p) for p in parts], np.concatenate(parts)
            keys, parts, size = [], [], 0
        keys.append(key)
        parts.append(ids)
        size += len(ids)
    if keys:
        yield keys, [len(p) for p in parts], np.concatenate(parts)


BLOCK_SCHEMA = "part int, block int, n_docs long, n_ids long, low_key long, high_key long, payload binary"
HEADER_SCHEMA = "version int, tokenizer_sha256 string, symbols int, end_id int, n_ids long, bits int, freq array<int>"


def write(docs: DataFrame, out: str, tokenizer: str, key: str = "doc_id", text: str = "text",
          end_id: int | None = 0) -> None:
    """Encode ``docs`` with the tokenizer file at ``tokenizer`` and write the
    token file to the new folder ``out``."""
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        data = f.read()
    symbols = Tokenizer.from_buffer(data).get_vocab_size(with_added_tokens=True)
    symbols = max(symbols, 0 if end_id is None else end_id + 1)
    width = id_width(symbols)
    tokens = staged(tokenize(docs, tokenizer, key, text, end_id), "tokens")
    counts = np.zeros(symbols, dtype=np.int64)
    for i, n in count_ids(tokens, symbols).collect():  # at most one row per vocabulary entry
        counts[i] = n
    table = Table(counts)
    shared = Shared(spark, table)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows():
            for batch in batches:
                for k, b in zip(batch.column(0), batch.column(1), strict=True):
                    yield k.as_py(), np.frombuffer(b.as_buffer(), dtype=width).astype(np.uint32)

        for number, (keys, sizes, ids) in enumerate(blocks_of(rows())):
            payload = pack_block(keys, sizes, ids, shared())
            named = [k for k in keys if k is not None]
            values = [part, number, len(keys), len(ids), min(named, default=None), max(named, default=None), payload]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()],
                                                  strict=True)],
                names=["part", "block", "n_docs", "n_ids", "low_key", "high_key", "payload"])

    total = int(counts.sum())
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_IDS))
    # the second sort column splits a key that very many rows share
    order = [F.col("doc_key").asc_nulls_first(), F.xxhash64("ids").asc()]
    ordered = tokens.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{out.rstrip('/')}/blocks")
    header = (VERSION, hashlib.sha256(data).hexdigest(), symbols, end_id, total, table.bits, table.freq.tolist())
    spark.createDataFrame([header], HEADER_SCHEMA).coalesce(1).write.parquet(f"{out.rstrip('/')}/header")


def opened(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, Table]:
    """(blocks, (part, block, start) with each block's place in the whole file,
    the shared table) of the token file in the folder ``out``."""
    head = spark.read.schema(HEADER_SCHEMA).parquet(f"{out.rstrip('/')}/header").first()
    if head is None or head.version != VERSION:
        raise ValueError(f"no token file of version {VERSION}: {out}")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{out.rstrip('/')}/blocks")
    # prefix sums in two steps: over the few parts, and over the blocks of each
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_start")) \
        .join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("start"))
    return blocks, places, Table.of(np.array(head.freq, dtype=np.int64), head.bits)


def read(spark: SparkSession, out: str, low: int | None = None, high: int | None = None,
         key: str = "doc_id") -> DataFrame:
    """Per document from the file alone: key, start (ids of all documents before
    it), n_tokens, ids (binary, little-endian unsigned 32-bit).

    With ``low`` or ``high`` only documents with a key in [low, high]: other
    blocks are pruned by their key columns, and in a block decoding starts at
    the checkpoint before the first such document."""
    if key in ("start", "n_tokens", "ids"):
        raise ValueError(f"the key cannot be named {key}: that is a column of the result")
    blocks, places, table = opened(spark, out)
    if low is not None:
        blocks = blocks.where(F.col("high_key") >= low)
    if high is not None:
        blocks = blocks.where(F.col("low_key") <= high)
    shared = Shared(spark, table)
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for start, payload in zip(batch.column(0), batch.column(1), strict=True):
                block = Block(payload.as_py())
                first, end = block.between(low, high)
                ends = np.cumsum(block.sizes)
                at = ends[first:end] - block.sizes[first:end]
                base = int(at[0]) if len(at) else 0
                ids = block.ids(shared(), base, int(ends[end - 1]) if end else 0).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.keys[first:end], pa.int64()), pa.array(start.as_py() + at, pa.int64()),
                     pa.array(block.sizes[first:end], pa.int64()),
                     pa.array([ids[a - base:b - base].tobytes() for a, b in zip(at, ends[first:end], strict=True)],
                              pa.binary())],
                    names=[key, "start", "n_tokens", "ids"])

    return blocks.join(places, ["part", "block"]).select("start", "payload").mapInArrow(run, schema)


def read_span(spark: SparkSession, out: str, first: int, last: int) -> DataFrame:
    """The ids at the places ``first`` up to ``last`` (exclusive) of the whole
    file, across document borders: rows (start, n_tokens, ids), one for each
    block that holds some. Only those blocks' payloads are read, each from the
    checkpoint before."""
    blocks, places, table = opened(spark, out)
    shared = Shared(spark, table)

    def run(batches):
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = Block(payload.as_py()).ids(shared(), max(0, first - start), last - start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([max(first, start)], pa.int64()), pa.array([len(ids)], pa.int64()),
                     pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["start", "n_tokens", "ids"])

    wanted = blocks.select("part", "block", "n_ids").join(places, ["part", "block"]) \
        .where((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first)).select("part", "block", "start")
    return blocks.join(wanted, ["part", "block"]).select("start", "payload") \
        .mapInArrow(run, "start long, n_tokens long, ids binary")


def digest(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    out = scratch_path(spark, "token-file")
    write(docs, out, path, end_id=0)
    return read(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
