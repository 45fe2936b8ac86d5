"""Exact BPE encoding by backtracking over longest matches, and decoding.

A word is a string of atoms (one per byte; with an end-of-word suffix the last
byte is an atom of its own). An Aho-Corasick automaton over all tokens gives,
in one pass, the longest token that starts at each place. The encoder takes
longest tokens from the left and accepts a token only if it is compatible with
the one before: two neighbouring tokens are compatible if byte-pair merging of
their joined string would keep the border between them, which the merge table
answers by walking down both tokens' splits. A token that fits nowhere is
replaced by its longest proper prefix token, and a place from which no token
fits is marked and left backwards. Marked places are never tried again, so the
work is linear in the word, and the result equals that of the merges.

Decoding copies each token's bytes from one flat buffer by an offset table.

Texts are split at single spaces, where no pre-token reaches across; each
worker process keeps the encodings of the pieces it met in a bounded table.

Defined results: a null text encodes like an empty one (no ids); very long
texts are encoded whole; repeated rows are rows of their own; an empty table
gives an empty frame; other columns are carried only if asked for.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from stanceflow.llm.common import Shared, cached, release_memory

#: Entries of a worker's table of counted pieces; the table is emptied when full.
PIECE_TABLE = 500_000

#: Encoded pieces and pre-tokens in each half of a worker's two tables, and pairs
#: of neighbouring tokens whose results it keeps. An entry of a table takes some
#: 200 bytes: 90 MB in all, as a worker shares its executor's memory with those of
#: the other cores and with the JVM.
HALF_ENCODED = 120_000
HALF_WORDS = 100_000
PAIR_TABLE = 200_000

#: Text handled by one output batch (characters); with its ids and decoded text
#: an encoder's batch takes several times that.
BATCH_CHARS = 4_000_000
ENCODED_CHARS = 1_000_000

#: Characters on which the ``regex`` module and the tokenizer's own engine agree
#: by test; pieces with any other go through the tokenizer's pre-tokeniser.
PLAIN = re.compile(r"[\x21-\x7e\xa1-ɏ ]*").fullmatch


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merge tables of a tokenizer file. Tokens are numbered by rank: atoms
    first, then merges in order; ``ids`` maps ranks to vocabulary ids.

    ``alone[r]``: proven, by encoding its own string, that token r stands alone
    for that string. Others can never appear and are left out of the matching."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.data = data
        self.suffix = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = list(byte_alphabet().values())
        spelled = letters + [c + self.suffix for c in letters] if self.suffix else letters
        atom = {s: chr(0x100 + i) for i, s in enumerate(spelled)}
        self.inner = {b: atom[c] for b, c in byte_alphabet().items()}
        self.last = {b: atom[c + self.suffix] for b, c in byte_alphabet().items()}
        self.strings = [atom[s] for s in spelled]
        self.ids = [vocab.get(s, -1) for s in spelled]
        rank = {s: i for i, s in enumerate(spelled)}
        self.split = [(i, i) for i in range(len(spelled))]
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            r, x, y = len(self.strings), rank[a], rank[b]
            if a + b in rank:
                raise ValueError("two merges give one token: ranks do not order this vocabulary")
            rank[a + b] = r
            self.strings.append(self.strings[x] + self.strings[y])
            self.split.append((x, y))
            self.pair[x, y] = r
            self.ids.append(vocab[a + b])
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.specials.items()}
        size = max(names) + 1
        if self.suffix:
            spelt = [names.get(i, "").encode() + b" " for i in range(size)]
        else:  # byte-level: a token spells its bytes, and nothing stands between tokens
            back = {c: b for b, c in byte_alphabet().items()}
            special = set(self.specials.values())
            spelt = [names.get(i, "").encode() if i in special else bytes([back[c] for c in names.get(i, "")])
                     for i in range(size)]
        self.flat = np.frombuffer(b"".join(spelt), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(s) for s in spelt])]).astype(np.int64)
        n = len(self.strings)
        self.keeps: dict[int, bool] = {}
        self.alone = [True] * n
        self._tables()
        self.alone = [self.encode_atoms(s) == [r] for r, s in enumerate(self.strings)]
        self._tables()

    def _tables(self) -> None:
        known = {s: r for r, s in enumerate(self.strings) if self.alone[r]}
        self.shorter = [-1] * len(self.strings)
        for s, r in known.items():
            for k in range(len(s) - 1, 0, -1):
                if s[:k] in known:
                    self.shorter[r] = known[s[:k]]
                    break
        self.length = [len(s) for s in self.strings]
        self.automaton = ahocorasick.Automaton()
        for s, r in known.items():
            self.automaton.add_word(s, r)
        self.automaton.make_automaton()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "keeps")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.keeps = {}
        self._tables()

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging keeps the border between tokens a and b: no pair of
        parts that meet at the border merges before both parts are used up."""
        pair, split, limit = self.pair, self.split, len(self.strings)
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            # undo the later of the two merges; what it undoes bounds the rank
            if a > b:
                limit, a2 = a, split[a][1]
                if a2 == a:
                    return True
                a = a2
            else:
                limit, b2 = b + 1, split[b][0]
                if b2 == b:
                    if split[a][1] == a:
                        return True
                    limit, a = a, split[a][1]
                else:
                    b = b2

    def encode_atoms(self, word: str) -> list[int]:
        """Ranks of the tokens of a string of atoms."""
        n = len(word)
        longest = [-1] * (n + 1)
        length, keeps = self.length, self.keeps
        if len(keeps) > PAIR_TABLE:
            keeps.clear()
        for end, r in self.automaton.iter(word):
            longest[end + 1 - length[r]] = r
        shorter, compatible = self.shorter, self.compatible
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            before = out[-1] if out else -1
            while token >= 0:
                end = pos + length[token]
                if not dead[end]:
                    if before < 0:
                        break
                    kept = keeps.get(before << 32 | token)
                    if kept is None:
                        kept = keeps[before << 32 | token] = compatible(before, token)
                    if kept:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos = end
                token = longest[pos]
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= length[token]
        return out

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Vocabulary ids of one pre-token given as bytes."""
        inner = self.inner
        ids = self.ids
        return [ids[r] for r in self.encode_atoms("".join(map(inner.__getitem__, piece[:-1])) + self.last[piece[-1]])]

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings as bytes: joined by single spaces where words have an
        end mark (a tokenizer file without a decoder joins them so), else as
        they follow each other."""
        if not len(ids):
            return b""
        start = self.offset[ids]
        size = self.offset[ids + 1] - start
        ends = np.cumsum(size)
        where = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        out = self.flat[where].tobytes()
        return out[:-1] if self.suffix else out


class PreTokens:
    """Pre-tokens of a piece of text without special strings, as byte strings.

    ``pattern``: the file's pattern for plain pieces; ``lower``: the file
    normalises (NFC, white space, lower case) first."""

    def __init__(self, vocabulary: Vocabulary):
        spec = json.loads(vocabulary.data)
        # cutting and normalising need no vocabulary, which takes the library 40 MB
        bare = {**spec, "model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [],
                "post_processor": None, "decoder": None}
        self.tokenizer = Tokenizer.from_str(json.dumps(bare))
        self.lower = spec["normalizer"] is not None
        if self.lower:
            pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        else:
            # fixed value: the pattern that byte-level pre-tokenisation uses
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.find = regex.compile(pattern).findall
        self.back = {ord(c): b for b, c in byte_alphabet().items()}

    def __call__(self, text: str) -> list[bytes]:
        if text.isalpha() and text.isascii():  # letters are never cut
            return [(text.lower() if self.lower else text).encode()]
        if PLAIN(text):
            if self.lower and text.isascii():
                text = text.lower()
            elif self.lower:
                text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
            return [p.encode() for p in self.find(text)]
        if self.lower:
            text = self.tokenizer.normalizer.normalize_str(text)
        back = self.back
        return [bytes([back[ord(c)] for c in p]) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class Halves(dict):
    """A bounded table: when it is full its entries become the old half, and
    those that are asked for again move back."""

    def __init__(self, half: int):
        super().__init__()
        self.half = half
        self.old: dict = {}

    def trim(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()

    def again(self, key):
        """The old half's value, now kept; none if it is not there."""
        value = self.old.pop(key, None)
        if value is not None:
            self[key] = value
        return value


class Encoder:
    """Encodes texts piece by piece with a bounded table of known pieces.
    ``pack``: what is kept per piece, from its list of ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pre = PreTokens(vocabulary)
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.specials, key=len, reverse=True))) or r"(?!)")
        self.known = Halves(HALF_ENCODED)  # piece: packed ids
        self.words = Halves(HALF_WORDS)  # pre-token: ids

    def add_words(self, out: list[int], text: str) -> None:
        """Append the ids of a text without special strings. Pieces share their
        pre-tokens: marks, and words that differ in case or marks only."""
        words = self.words
        words.trim()
        for p in self.pre(text):
            ids = words.get(p)
            if ids is None:
                ids = words.again(p)
            if ids is None:
                ids = words[p] = tuple(self.vocabulary.encode_bytes(p))
            out += ids

    def ids_of(self, text: str) -> list[int]:
        """Ids of a text by pre-tokens, special strings recognised."""
        out: list[int] = []
        at = 0
        if self.special.search(text) is None:  # most pieces
            self.add_words(out, text)
            return out
        for m in self.special.finditer(text):
            self.add_words(out, text[at:m.start()])
            out.append(self.vocabulary.specials[m[0]])
            at = m.end()
        self.add_words(out, text[at:])
        return out

    def pack(self, piece: str) -> bytes:
        ids = self.ids_of(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers. Files
        with word ends drop white space, so pieces are cut at spaces and line
        ends; others keep it, and their own pre-tokens are the pieces."""
        if not self.vocabulary.suffix:
            return self.encode_spaced(text)
        known = self.known
        pieces = text.replace("\n", " ").split(" ")
        found = list(map(known.get, pieces))
        if None in found:
            known.trim()
            for i, b in enumerate(found):
                if b is None:
                    p = pieces[i]
                    b = known.get(p)
                    if b is None:
                        b = known.again(p)
                    if b is None:
                        b = known[p] = self.pack(p)
                    found[i] = b
        return b"".join(found)

    def encode_spaced(self, text: str) -> bytes:
        v, known, at = self.vocabulary, self.known, 0
        known.trim()
        out: list[bytes] = []
        for start, end, name in [*((m.start(), m.end(), m[0]) for m in self.special.finditer(text)),
                                 (len(text), len(text), None)]:
            for p in self.pre(text[at:start]):
                b = known.get(p)
                if b is None:
                    b = known.again(p)
                if b is None:
                    ids = v.encode_bytes(p)
                    b = known[p] = struct.pack(f"<{len(ids)}I", *ids)
                out.append(b)
            if name is not None:
                out.append(struct.pack("<I", v.specials[name]))
            at = end
        return b"".join(out)


def load(spark, path: str) -> Shared:
    """Broadcast merge tables of a tokenizer file (their size is the file's, a
    few MB, whatever the corpus). The file is read on the driver only."""
    with open(path, "rb") as f:
        data = f.read()
    return Shared(spark, cached(("vocabulary", hashlib.sha256(data).hexdigest()), lambda: Vocabulary(data)))


def slices(column: pa.ChunkedArray | pa.Array, most: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of at most ``most`` characters or one text."""
    at, rows, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if rows and size + len(text) > most:
            yield at, rows
            at, rows, size = i, [], 0
        rows.append(text)
        size += len(text)
    if rows:
        yield at, rows


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           decode: bool = True) -> DataFrame:
    """``keep`` columns + n_tokens (long), ids (binary, little-endian unsigned
    32-bit) and, with ``decode``, the text decoded from those ids."""
    made = {"n_tokens", "ids", "decoded"}
    if made.intersection(c.lower() for c in keep):
        raise ValueError(f"columns named {sorted(made)} are the result's own: rename those to keep")
    tables = load(df.sparkSession, path)
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
                          + ([T.StructField("decoded", T.StringType())] if decode else []))
    n = len(keep)

    def encoded(encoder, batch):
        for at, texts in slices(batch.column(n), ENCODED_CHARS):
            packed = [encoder.encode(t) for t in texts]
            arrays = [batch.column(i).slice(at, len(texts)) for i in range(n)]
            arrays += [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
            names = [*batch.schema.names[:n], "n_tokens", "ids"]
            if decode:
                made = [encoder.vocabulary.decode(np.frombuffer(p, dtype="<u4").astype(np.int64)) for p in packed]
                arrays.append(pa.array(made, pa.binary()).cast(pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        encoder = cached(("encoder", tables.key), lambda: Encoder(tables()))
        for batch in batches:
            yield from encoded(encoder, batch)
            del batch  # else it stays beside the next one
        release_memory()

    return df.select(*keep, text).mapInArrow(run, schema)
