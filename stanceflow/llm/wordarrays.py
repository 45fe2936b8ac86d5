"""Words of a batch of texts as integer arrays, and the wavelet matrix over
such arrays. Every batch is bounded; Spark deals the batches out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Weight of a row besides its text, so that empty texts fill a bundle too.
ROW_BYTES = 16

#: Bytes of the word class ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` with A-Z lower-cased;
#: all others become spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                for b in range(256))


def bundles(batches: Iterable[pa.RecordBatch], at: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs whose texts (column number ``at``) hold at
    most ``most`` bytes, or one row."""
    held, size = [], 0
    for batch in batches:
        weights = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(weights.astype(np.int64) + ROW_BYTES)
        start, done = 0, 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, done + most - size, side="right"))
            if stop == start and not held:
                stop = start + 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - done
                start, done = stop, int(ends[stop - 1])
            if start < batch.num_rows or size >= most:
                yield _glued(held)
                held, size = [], 0
    if held:
        yield _glued(held)


def _glued(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(held).combine_chunks()
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) for c in whole.columns], names=whole.column_names)


def translated(column: pa.Array, table: bytes | None) -> pa.Array:
    """Null texts as empty ones; bytes mapped by ``table`` (which maps ASCII to
    ASCII and leaves the rest)."""
    column = pa.concat_arrays([pc.fill_null(column, "")])
    if table is None or not len(column):
        return column
    _, offsets, data = column.buffers()
    mapped = (data.to_pybytes() if data is not None else b"").translate(table)
    return type(column).from_buffers(len(column), offsets, pa.py_buffer(mapped), None, 0, column.offset)


def numbered(column: pa.Array, table: bytes | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word numbers of all rows in a row, words per row, the word of each
    number). Words are the runs of what is no ASCII white space after ``table``."""
    words = pc.ascii_split_whitespace(translated(column, table))
    coded = words.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    owner = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # white space at an end of a text
        real = ids != empty
        ids, owner = ids[real], owner[real]
    return ids, np.bincount(owner, minlength=len(column)).astype(np.int64), coded.dictionary


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets 0, n0, n0 + n1, ... with the total last."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)))


def spread(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n in ``counts``, one after another."""
    offsets = starts_of(counts)
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)


def zero_bits(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Per bit, highest first: which values have a 0 there, in the order that
    the wavelet matrix keeps them in (zeros of the level above first)."""
    for level in range(bits - 1, -1, -1):
        zero = values & (1 << level) == 0
        yield zero
        if level:
            values = np.concatenate((values[zero], values[~zero]))


class Wavelet:
    """Wavelet matrix: an array of ``n`` integers below 2^bits as one table of
    zero counts per bit, highest first. All queries take arrays of places."""

    def __init__(self, n: int, levels: Iterable[np.ndarray]):
        self.n, self.tables = n, []
        for zero in levels:
            table = np.zeros(n + 1, np.int32)
            np.cumsum(zero, out=table[1:])
            self.tables.append(table)
        self.bits = len(self.tables)

    @classmethod
    def of(cls, values: np.ndarray, bits: int) -> Wavelet:
        return cls(len(values), zero_bits(values, bits))

    @classmethod
    def unpacked(cls, data: bytes, n: int, bits: int) -> Wavelet:
        """From ``packed`` bits."""
        width = (n + 7) // 8
        return cls(n, (np.unpackbits(np.frombuffer(data, np.uint8, width, level * width), count=n)
                       for level in range(bits)))

    def _levels(self):
        return zip(self.tables, range(self.bits - 1, -1, -1), strict=True)

    def follow(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first occurrence of ``value`` at or after ``at`` would stand
        in the fully sorted array of the last level."""
        for table, level in self._levels():
            zeros = table[at]
            at = np.where((value >> level) & 1 == 0, zeros, table[-1] + at - zeros)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value at each place, its place in the last level)."""
        value = np.zeros(len(at), np.int64)
        for table, level in self._levels():
            zeros = table[at]
            one = table[at + 1] == zeros
            value |= one.astype(np.int64) << level
            at = np.where(one, table[-1] + at - zeros, zeros)
        return value, at

    def smaller(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in places [lo, hi) are below ``bound`` (< 2^bits)."""
        count = np.zeros(len(lo), np.int64)
        for table, level in self._levels():
            zl, zh = table[lo], table[hi]
            one = (bound >> level) & 1 == 1
            count += np.where(one, zh - zl, 0)
            lo = np.where(one, table[-1] + lo - zl, zl)
            hi = np.where(one, table[-1] + hi - zh, zh)
        return count

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) in places [lo, hi), k < hi - lo."""
        value = np.zeros(len(lo), np.int64)
        for table, level in self._levels():
            zl, zh = table[lo], table[hi]
            one = k >= zh - zl
            k = np.where(one, k - (zh - zl), k)
            value |= one.astype(np.int64) << level
            lo = np.where(one, table[-1] + lo - zl, zl)
            hi = np.where(one, table[-1] + hi - zh, zh)
        return value


def packed(values: np.ndarray, bits: int) -> bytes:
    """A wavelet matrix as bits, each level from a whole byte on."""
    return b"".join(np.packbits(zero).tobytes() for zero in zero_bits(values, bits))
