"""Token counts with a whole-token shortcut.

Offline, each string of the vocabulary is encoded by the merge rules; those
that come out as the one token they name are proven (their count is 1 in any
text, as a pre-token is encoded alone). Counting looks every pre-token up in
that set and merges only the rest.

Defined results: a null text counts like an empty one (no tokens, no bytes);
special strings inside a text are one token each, as the tokenizer's default
has it; texts are counted whole; repeated rows are rows of their own; an empty
table gives an empty frame; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceflow.llm.bpe import PIECE_TABLE, Encoder, Vocabulary, load, slices
from stanceflow.llm.common import cached

#: White space beside a space: such texts are split with more care.
ODD_SPACE = re.compile(r" \s|\s ").search
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)").split


def pieces(text: str) -> list[str]:
    """Cuts at single spaces between other characters, where byte-level
    pre-tokenisation always cuts: all pieces but the first lost one space."""
    return SINGLE_SPACE(text) if ODD_SPACE(text) else text.split(" ")


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.encoder = Encoder(vocabulary)
        atoms = {**{a: bytes([b]) for b, a in vocabulary.inner.items()}}
        self.whole = {b"".join(atoms[c] for c in s) for r, s in enumerate(vocabulary.strings) if vocabulary.alone[r]}
        self.known: dict[str, int] = {}

    def count_piece(self, text: str) -> int:
        e, total, at = self.encoder, 0, 0
        cuts = [(m.start(), m.end()) for m in e.special.finditer(text)] + [(len(text), len(text))]
        for start, end in cuts:
            for p in e.pre(text[at:start]):
                total += 1 if p in self.whole else len(e.vocabulary.encode_bytes(p))
            total += end > start
            at = end
        return total

    def count(self, text: str) -> int:
        first, *rest = pieces(text)
        known = self.known
        found = list(map(known.get, rest))
        if None in found:
            if len(known) > PIECE_TABLE:
                known.clear()
            for i, n in enumerate(found):
                if n is None:
                    p = rest[i]
                    n = known.get(p)
                    if n is None:
                        n = known[p] = self.count_piece(" " + p)
                    found[i] = n
        return self.count_piece(first) + sum(found)


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 limit: int = 1024) -> DataFrame:
    """``keep`` columns + n_bytes, n_tokens (long) and over_limit."""
    tables = load(df.sparkSession, path)
    if tables().suffix:
        raise ValueError("the whole-token shortcut is for byte-level files without word ends")
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    n = len(keep)

    def run(batches):
        counter = cached(("counter", tables.key), lambda: Counter(tables()))
        for batch in batches:
            for at, texts in slices(batch.column(n)):
                arrays = [batch.column(i).slice(at, len(texts)) for i in range(n)]
                arrays += [pa.array([len(t.encode()) for t in texts], pa.int64()),
                           pa.array([counter.count(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:n], "n_bytes", "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
