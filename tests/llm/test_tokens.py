import hashlib
import os
import random
import struct
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_help import EDGES, documents, frame
from tokenizers import Tokenizer

from stanceflow.llm import bpe, counts, queries, rans

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "abcdefghij  \n\t'sdtlre.,!?0129ABCÉéèßñçÀΣσς中文\U0001f600é ​\x85\x1c<|>½²ǅﬁİ"


def odd_texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)] + [
        "<|endoftext|>", "a <|endoftext|> b", "a<|startoftext|>b  <|endoftext|>", "  x  y ", "\n\n a\n",
        "don't I'LL we've", "ab" * 2000, " ", "\n", "a ", " a", "١٢٣ x", "ẞ ſ K"]


@pytest.fixture(scope="module")
def vocabularies():
    return {p: bpe.Vocabulary(open(p, "rb").read()) for p in (WORD, BYTE)}


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_backtracking_equals_the_library(vocabularies, path):
    v = vocabularies[path]
    encoder, tok = bpe.Encoder(v), Tokenizer.from_file(path)
    for text in odd_texts(1500):
        want = tok.encode(text, add_special_tokens=False).ids
        assert encoder.ids_of(text) == want, text
        packed = encoder.encode(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == want
        if want:
            assert v.decode(np.array(want, dtype=np.int64)).decode() == tok.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_plain_characters_split_alike(vocabularies, path):
    pre = bpe.PreTokens(vocabularies[path])
    for code in [*range(0x21, 0x7F), *range(0xA1, 0x250)]:
        c = chr(code)
        text = f"a{c}1{c} {c}{c}b"
        assert bpe.PLAIN(text)
        normal = pre.tokenizer.normalizer.normalize_str(text) if pre.lower else text
        want = [bytes(pre.back[ord(x)] for x in p) for p, _ in pre.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        assert pre(text) == want


def test_whole_tokens_are_proven(vocabularies):
    v = vocabularies[BYTE]
    assert all(v.encode_atoms(s) == [r] for r, s in enumerate(v.strings) if v.alone[r])
    counter, tok = counts.Counter(v), Tokenizer.from_file(BYTE)
    for text in odd_texts(1500, seed=6):
        assert counter.count(text) == len(tok.encode(text, add_special_tokens=False).ids), text


def test_queries_equal_the_library(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(frame(spark, EDGES))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    order = lambda rows: sorted(rows, key=str)
    want, sizes = [], []
    for key, text in rows:
        ids = word.encode(text, add_special_tokens=False).ids
        decoded = word.decode(ids, skip_special_tokens=False)
        want.append((key, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(decoded.encode())))
        n = len(byte.encode(text, add_special_tokens=False).ids)
        sizes.append((key, len(text.encode()), n, n > 1024))
    encoded = queries.bpe_digest(bpe.encode(docs, WORD), "doc_id")
    assert order(tuple(r) for r in encoded.collect()) == order(want)
    assert order(tuple(r) for r in counts.count_tokens(docs, BYTE).collect()) == order(sizes)
    empty = frame(spark, [])
    assert bpe.encode(empty, WORD).count() == 0 and counts.count_tokens(empty, BYTE).count() == 0


def test_token_files_equal_the_library(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(
        frame(spark, [(i + 1000, t) for i, t in EDGES if i not in (None, 6)] + [(-5, "first"), (None, "before all")]))
    tok, start, want = Tokenizer.from_file(BYTE), 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in rans.digest(spark, docs, BYTE).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert rans.digest(spark, frame(spark, []), BYTE).count() == 0


def test_byte_level_files_keep_white_space(spark):
    rows = [(0, "hello world"), (1, " two\n\nlines  <|endoftext|> x"), (2, None), (3, "")]
    tok = Tokenizer.from_file(BYTE)
    for r in bpe.encode(frame(spark, rows), BYTE).collect():
        text = rows[r.doc_id][1] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
        assert r.decoded == text
    named = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, ids int")
    with pytest.raises(ValueError, match="rename"):
        bpe.encode(named, WORD, keep=("doc_id", "ids"))


def token_file(spark, folder):
    """(folder, {key: (start, ids)}) of a file with several blocks of several checkpoints."""
    docs = documents(spark).select("doc_id", "text").unionByName(
        frame(spark, [(None, "no key"), (10_001, "long text " * 700_000), (10_001, "again")]))
    out = f"{folder}/kept"
    rans.write(docs, out, BYTE)
    return out, docs


READER = """
import sys
sys.path[:0] = [{root!r}, {tests!r}]
from pyspark.sql import SparkSession
from stanceflow.llm import rans
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
rows = rans.read(spark, {out!r}).collect()
print("READ", len(rows), sum(r.n_tokens for r in rows), sum(len(r.ids) for r in rows))
"""


def test_a_kept_file_is_read_by_a_new_session_and_in_part(spark, tmp_dir):
    out, docs = token_file(spark, tmp_dir)
    tok = Tokenizer.from_file(BYTE)
    whole = sorted(rans.read(spark, out).collect(), key=lambda r: r.start)
    flat = np.concatenate([np.frombuffer(r.ids, "<u4") for r in whole])
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(tuple(tok.encode(r.text or "", add_special_tokens=False).ids))
    assert len(whole) == docs.count() and whole[0].doc_id is None
    for r in whole:
        ids = flat[r.start:r.start + r.n_tokens].tolist()
        assert ids[-1] == 0 and tuple(ids[:-1]) in texts[r.doc_id]
    # a part of the file, by keys and by places (also inside the text of several checkpoints)
    some = sorted(rans.read(spark, out, low=7, high=9).collect(), key=lambda r: r.start)
    assert some == [r for r in whole if r.doc_id is not None and 7 <= r.doc_id <= 9] and some
    assert [r.doc_id for r in rans.read(spark, out, low=10_000).collect()] == [10_001, 10_001]
    assert rans.read(spark, out, high=-1).count() == 0
    for first, last in ((0, 5), (len(flat) - 900_000, len(flat) - 3), (3, 3), (len(flat), len(flat) + 9), (0, len(flat))):
        got = sorted(rans.read_span(spark, out, first, last).collect(), key=lambda r: r.start)
        joined = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]) if got else np.zeros(0, "<u4")
        assert np.array_equal(joined, flat[first:last]) and all(r.n_tokens * 4 == len(r.ids) for r in got)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = READER.format(root=root, tests=os.path.dirname(os.path.abspath(__file__)), out=out)
    told = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert f"READ {len(whole)} {len(flat)} {4 * len(flat)}" in told.stdout, told.stderr[-2000:]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        rans.write(frame(spark, [(1, "x")]), out, BYTE)


def test_a_block_is_decoded_from_the_nearest_checkpoint(monkeypatch):
    ids = np.arange(1000, dtype=np.uint32) % 37
    table = rans.Table(np.bincount(ids))
    data = rans.pack_block([1, 2], [600, 400], ids, table, lanes=4, every=5)
    seen = []
    plain = rans.decode_stream
    monkeypatch.setattr(rans, "decode_stream", lambda *a: seen.append(a[6:]) or plain(*a))
    assert np.array_equal(rans.Block(data).ids(table, 605, 650), ids[605:650])
    assert seen == [(30, 33)]
    damaged = bytearray(data)
    damaged[struct.calcsize("<4s7I") + 9] ^= 1
    with pytest.raises(ValueError, match="document list"):
        rans.Block(bytes(damaged))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.integers(1, 9), st.integers(1, 5), st.integers(10, 20))
def test_rans_round_trip(ids, lanes, every, bits):
    ids = np.array(ids, dtype=np.uint32)
    table = rans.Table(np.bincount(ids, minlength=301), bits)
    assert not len(ids) or int(table.freq.sum()) == 1 << bits
    half = len(ids) // 2
    block = rans.pack_block([3, None], [half, len(ids) - half], ids, table, lanes, every)
    keys, parts = rans.unpack_block(block, table)
    assert keys == [3, None] and np.array_equal(np.concatenate(parts), ids)
    if len(ids):
        stream, marks = rans.encode_stream(ids, table, lanes, every)
        for c in range(len(marks)):
            part = rans.decode_stream(stream, marks, len(ids), table, lanes, every, c, c + 1)
            assert np.array_equal(part, ids[c * every * lanes:(c + 1) * every * lanes])


def test_rans_is_near_the_entropy_and_checked():
    rng = np.random.default_rng(2)
    p = 1 / (np.arange(5000) + 1)
    ids = rng.choice(5000, 200_000, p=p / p.sum()).astype(np.uint32)
    n = np.bincount(ids, minlength=5000)
    table = rans.Table(n)
    stream, _ = rans.encode_stream(ids, table)
    used = n[n > 0]
    entropy = -(used / n.sum() * np.log2(used / n.sum())).sum()
    assert len(stream) * 32 / len(ids) < entropy * 1.01 + 0.01
    block = bytearray(rans.pack_block([1], [len(ids)], ids, table))
    block[-9] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.unpack_block(bytes(block), table)


def test_words_of_many_pieces_are_encoded_once():
    """op3: pieces that differ in case or marks share their words' encodings."""
    with open(WORD, "rb") as f:
        data = f.read()
    encoder = bpe.Encoder(bpe.Vocabulary(data))
    met, plain = [], encoder.vocabulary.encode_bytes
    encoder.vocabulary.encode_bytes = lambda p: met.append(p) or plain(p)
    text = "Thorwenst thorwenst. THORWENST, thorwenst; <|startoftext|>thorwenst. İthorwenst É é é"
    got = np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert len(met) == len(set(met)) and met.count(b"thorwenst") == 1
    assert got == Tokenizer.from_buffer(data).encode(text, add_special_tokens=False).ids


def test_marked_words_are_put_together(monkeypatch):
    """op6: a word that ends in a mark is not encoded again."""
    with open(BYTE, "rb") as f:
        data = f.read()
    tokens, asked = rans.Tokens(data), []
    plain = tokens.library
    monkeypatch.setattr(tokens, "library", lambda text: asked.append(text) or plain(text))
    texts = ["Whonha whonha. whonha, whonha\nwhonha. it's its. 'tis. a.b. 12. é. . ?!", "whonha; .\nwhonha! whonha."]
    want = [np.array(Tokenizer.from_buffer(data).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokens.encode(texts) == want
    assert sum(t.count("whonha") for t in asked) == 2        # after a space and after a line end


def test_an_encoder_keeps_little(monkeypatch):
    """pipeline, bpe: a worker's tables are halved when full, results stay; the
    library's own vocabulary is not loaded."""
    for name in ("HALF_ENCODED", "HALF_WORDS"):
        monkeypatch.setattr(bpe, name, 5)
    r = random.Random(3)
    words = ["".join(r.choice("abcdeÉ'.") for _ in range(r.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(r.choices(words, k=9)) for _ in range(80)] + ["<|endoftext|> a b", "\n\n x  y"]
    for path in (WORD, BYTE):
        with open(path, "rb") as f:
            data = f.read()
        encoder, tok = bpe.Encoder(bpe.Vocabulary(data)), Tokenizer.from_buffer(data)
        assert encoder.pre.tokenizer.get_vocab_size() == 0
        for text in texts:
            got = np.frombuffer(encoder.encode(text), "<u4").tolist()
            assert got == tok.encode(text, add_special_tokens=False).ids, text
            assert all(len(t) <= 40 and len(t.old) <= 40 for t in (encoder.known, encoder.words))
        assert encoder.known.old


def test_a_bpe_output_batch_is_small(spark):
    """pipeline, bpe: ids and decoded texts leave in batches of a million characters."""
    rows = [(i, "word " * 60_000) for i in range(10)]
    tok = len(Tokenizer.from_file(WORD).encode(rows[0][1], add_special_tokens=False).ids)
    seen = []
    column = spark.createDataFrame(rows, "doc_id long, text string").toArrow().column("text")
    for at, texts in bpe.slices(column, bpe.ENCODED_CHARS):
        seen.append((at, sum(map(len, texts))))
    assert sum(n for _, n in seen) == 3_000_000 and max(n for _, n in seen) <= 1_000_000
    got = bpe.encode(frame(spark, rows), WORD).collect()
    assert sorted(r.doc_id for r in got) == list(range(10)) and {r.n_tokens for r in got} == {tok}


@pytest.mark.parametrize("end", [None, 0])
def test_columns_of_texts_are_encoded_whole(vocabularies, monkeypatch, end):
    """op6: regular texts go by columns, the others whole, in the rows' order;
    the library gets pieces with one space between, no line ends for each."""
    tok = Tokenizer.from_file(BYTE)
    texts = odd_texts(400, seed=9) + [t for _, t in EDGES] + [f"x{chr(c)}y é." for c in range(1, 0x300)]
    tokens, asked = rans.Tokens(vocabularies[BYTE].data, "<u2"), []
    plain = tokens.library
    monkeypatch.setattr(tokens, "library", lambda text: asked.append(text) or plain(text))
    column = pa.array(texts, pa.string())
    for some in (column, column.slice(11, 300), column.slice(5, 0)):
        want = [tok.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end]) for t in some.to_pylist()]
        got = [np.frombuffer(b, "<u2").tolist() for b in tokens.encode_column(some, end).to_pylist()]
        assert got == want
    asked.clear()
    assert tokens.encode(["oneq twoq threeq\nfourq", "threeq twoq."]) == [
        np.array(tok.encode(t).ids, "<u2").tobytes() for t in ("oneq twoq threeq\nfourq", "threeq twoq.")]
    assert sum(t.count("\n") for t in asked) == 3 and sum(t.count("twoq") for t in asked) == 1
    cut = [(at, run.to_pylist()) for at, run in rans.runs(pa.array(["aaaaa", None, "", "b" * 9, "cc", "d"]), 6)]
    assert cut == [(0, ["aaaaa", None, ""]), (3, ["b" * 9]), (4, ["cc", "d"])]
