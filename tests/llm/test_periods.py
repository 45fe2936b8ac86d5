import hashlib
import re
import zlib

import numpy as np
import pytest
from llm_help import EDGES, documents, frame

from stanceflow.llm import periods


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_runs(w):
    """Longest stretches of each period, shortest period first."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(key, w):
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(key, text):
    w = planted(key, words_of(text))
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def rows_of(df):
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                          "collapsed_sha256"]
    return sorted(((r[0], tuple(r)[1:]) for r in df.collect()), key=repr)


def test_whole_table_equals_brute_force(spark):
    docs = documents(spark)
    got = rows_of(periods.digest(docs))
    assert got == sorted(((r.doc_id, expected(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    assert any(r[1][0] for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_random_words(seed):
    rng = np.random.default_rng(seed)
    for _ in range(300):
        docs = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(0, 70))
            w = rng.integers(0, rng.integers(2, 7), n).tolist()
            if n > 3 and rng.random() < 0.6:
                a = int(rng.integers(0, n))
                p = 1 + (n - a) // int(rng.integers(3, 9))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        offsets = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        start, length, period = periods.runs_of(np.array([x for d in docs for x in d], np.int32), offsets)
        owner = np.searchsorted(offsets, start, side="right") - 1
        got = [[] for _ in docs]
        for s, n, q, d in zip(start - offsets[owner], length, period, owner, strict=True):
            got[d].append((int(s), int(n), int(q)))
        assert got == [brute_runs(d) for d in docs]


def test_nested_and_touching_runs():
    """Runs inside runs, Fibonacci words, a shift in the period, powers of words."""
    fib = ["a", "ab"]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    cases = ["aaaaaab" * 6, "ab" * 10 + "ba" * 10, fib[-1], "a" * 64, ("abc" * 5 + "x") * 5, "abcab" * 4 + "abcabx",
             "".join(str(i % 3 % 2) for i in range(90)), "a" * 5, "ab" * 3, "abab" * 2, "a" * 6]
    for case in cases:
        ids = np.array([ord(c) for c in case], np.int32)
        got = list(zip(*(x.tolist() for x in periods.runs_of(ids, np.array([0, len(ids)]))), strict=True))
        assert got == brute_runs(case), case


def test_edges(spark):
    rows = EDGES + [(None, "a b " * 20), (10, "x " * 5), (11, "x " * 6), (12, " a\x0bb\x0ca\rb\ta\nb a b "),
                    (13, "no break no break " * 4), (14, "\x1c\x00 " * 9)]
    for extra in (False, True):
        got = rows_of(periods.digest(frame(spark, rows, extra)))
        assert got == sorted(((k, expected(k, t)) for k, t in rows), key=repr)


def test_long_text_in_seconds(spark):
    """200,000 words: one long period, one word, and all of both again."""
    rng = np.random.default_rng(3)
    part = " ".join(rng.integers(0, 50_000, 30_000).astype(str))
    text = " ".join([part] * 5) + " same" * 50_000
    found = periods.find_runs(frame(spark, [(1, text)])).first()
    assert [tuple(r) for r in found["runs"]] == [(0, 150_000, 30_000), (150_000, 50_000, 1)]
    assert found["collapsed"] == part + " same" and found["n_words"] == 200_000


def test_bundles_and_tables(spark):
    docs = documents(spark)
    whole = sorted(map(repr, periods.find_runs(docs).collect()))
    assert sorted(map(repr, periods.find_runs(docs, bundle_bytes=3000).collect())) == whole
    assert rows_of(periods.digest(frame(spark, []))) == []
    with pytest.raises(ValueError):
        periods.find_runs(docs.withColumnRenamed("lang", "Runs"), ("doc_id", "Runs"))
