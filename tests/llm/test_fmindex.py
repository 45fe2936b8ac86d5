import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_help import EDGES, SF, documents, frame

from stanceflow.llm import fmindex
from stanceflow.llm.wordarrays import LETTERS, Wavelet, numbered, packed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def windows_of(items, window=10):
    out = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(tuple(w[i:i + window]), set()).add(item)
    return out


def expected(rows, items, window=10):
    windows = windows_of(items, window)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in rows:
        w, hit, ids = words_of(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i:i + size]))) is not None:
                    hit.update(range(i, i + size))
                    ids |= found - {None}
        listed = ",".join(sorted(map(str, ids)))
        out.append((key, len(w), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def bench(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(*r, 1, "w") for r in rows], "item_id long, text string, number int, window string")
    return spark.createDataFrame(rows, "item_id long, text string")


def rows_of(df):
    assert df.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table_equals_brute_force(spark):
    docs, items = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = rows_of(fmindex.digest(docs, items))
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "One, TWO"), (3, None), (4, " .,; "),
         (5, "word"), (6, "two three four five six seven eight nine ten eleven"), (None, "no key here"),
         (2, "another text of item two"), (7, "absent words only"), (8, "word " * 12), (9, "é ß")]


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    rows = EDGES + [(20, "zero one two three four five six seven eight nine ten eleven twelve"),
                    (21, "one two three four five six seven eight nine"), (22, "word word"), (23, "É é ß"),
                    (24, "six seven one two-three FOUR five six seven eight nine ten one two")]
    got = rows_of(fmindex.digest(frame(spark, rows, extra), bench(spark, ITEMS, extra)))
    assert got == expected(rows, ITEMS)


def test_empty_tables(spark):
    rows = [(1, "one two"), (2, None)]
    assert rows_of(fmindex.digest(frame(spark, rows), bench(spark, []))) == expected(rows, [])
    assert rows_of(fmindex.digest(frame(spark, []), bench(spark, ITEMS))) == []
    assert rows_of(fmindex.digest(frame(spark, []), bench(spark, []))) == []


def test_shards_blocks_and_windows(spark):
    """Many small shards and blocks give what one of each gives; spans are words to remove."""
    docs, items = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    true = expected([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 4)
    for shard, block in ((fmindex.SHARD_BYTES, fmindex.BLOCK_BYTES), (5000, 8000)):
        found = fmindex.decontaminate(docs, items, window=4, shard_bytes=shard, block_bytes=block).collect()
        got = sorted(((r.doc_id, r.n_words, sum(s["end"] - s["start"] for s in r.spans), len(r["items"]),
                       hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.spans)) for r in found), key=repr)
        assert got == true
        for r in found:
            assert all(a["end"] < b["start"] for a, b in zip(r.spans, r.spans[1:]))


def test_an_index_serves_later_test_sets(spark):
    docs = documents(spark)
    shards = fmindex.staged(fmindex.index(docs), "test-index")
    for items in ([(1, "the")], ITEMS):
        windows = fmindex.item_windows(bench(spark, items))
        numbers, blocks = fmindex.numbered_windows(windows, fmindex.BLOCK_BYTES)
        got = {r.doc_id: sum(s["end"] - s["start"] for s in r.spans)
               for r in fmindex.found(shards, windows, numbers, blocks).collect()}
        assert got == {r[0]: r[2] for r in expected([(r.doc_id, r.text) for r in docs.collect()], items)}


def test_search_and_locate_any_pattern():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcd"), n)) for n in (0, 1, 40, 200, 200, 7)] + ["b b b b b b b b"] * 3
    ids, counts, words = numbered(pa.array(texts), LETTERS)
    index = fmindex.Index(fmindex.packed_index(ids, counts, words))
    flat = [w for t in texts for w in [*t.split(), "|"]]
    patterns = [tuple(rng.choice(list("abcde"), rng.integers(1, 5))) for _ in range(200)]
    block = fmindex.Block(np.arange(len(patterns)), [" ".join(p) for p in patterns], 4)
    which, lo, hi = index.search(block.for_shard(index.words))
    got = {w: sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi, strict=True)}
    for i, p in enumerate(patterns):
        true = [k for k in range(len(flat)) if tuple(flat[k:k + len(p)]) == p]
        assert got.get(i, []) == true


def test_suffixes_are_sorted():
    rng = np.random.default_rng(6)
    for many in (2, 5000):
        text = rng.integers(1, many, 400)
        text[[50, 51, 120, 399]] = 0
        ends = np.flatnonzero(text == 0)
        key = [(-1, i) if w == 0 else (0, w) for i, w in enumerate(text.tolist())]
        assert fmindex.sorted_suffixes(text, ends).tolist() == sorted(range(400), key=lambda i: key[i:])


def test_wavelet_queries():
    rng = np.random.default_rng(7)
    values = rng.integers(0, 37, 500)
    for matrix in (Wavelet.of(values, 6), Wavelet.unpacked(packed(values, 6), 500, 6)):
        lo = rng.integers(0, 500, 200)
        hi = lo + rng.integers(1, 501 - lo)
        bound, k = rng.integers(0, 60, 200), rng.integers(0, hi - lo)
        parts = [np.sort(values[a:b]) for a, b in zip(lo, hi, strict=True)]
        assert matrix.smaller(lo, hi, bound).tolist() == [int((p < x).sum()) for p, x in zip(parts, bound, strict=True)]
        assert matrix.kth(lo, hi, k).tolist() == [int(p[i]) for p, i in zip(parts, k, strict=True)]
        assert matrix.access(np.arange(500))[0].tolist() == values.tolist()
