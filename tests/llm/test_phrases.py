import re
from collections import Counter, defaultdict

import pytest
from llm_help import EDGES, documents

from stanceflow.llm import phrases


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def counted(rows):
    """Per language: occurrences of all phrases of one to four words, number of words."""
    found, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                found[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return found, words


def ranked(rows, minimum, top):
    found, words = counted(rows)
    out = []
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= minimum}
        longer = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i:i + size]] = max(longer[p[i:i + size]], a)
        best = []
        for p, a in candidates.items():
            if 100 * longer[p] < 80 * a:
                s, _, left, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                    for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), left, r))
        for i, (s, a, p, left, r) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, r, words[lang], -s))
    return sorted(out)


def collect(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def texts(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_whole_table_equals_brute_force(spark):
    docs = documents(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert collect(phrases.collocations(docs)) == ranked(rows, 30, 2000)
    assert collect(phrases.collocations(docs, minimum=4, top=50)) == ranked(rows, 4, 50)


@pytest.mark.parametrize("sample", [1, 3, 1000])
def test_any_sample_gives_the_same(spark, sample):
    """An empty sample proposes nothing: all of it is left to the further passes."""
    docs = documents(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    found = phrases.frequent_phrases(docs, minimum=12, sample=sample)
    got = {(r.lang, r.phrase): r.n for r in found.where("k > 0").collect()}
    true, words = counted(rows)
    assert got == {(lang, " ".join(p)): n for lang, f in true.items() for p, n in f.items() if n >= 12}
    assert {r.lang: r.n for r in found.where("k = 0").collect()} == dict(words)


def test_edges(spark):
    rows = [("a", t) for _, t in EDGES] + [(None, "x y z. x y\tz,x Y z"), ("und", "X y z!x y z" * 9), ("", "p q " * 40),
                                          ("b", "é ü \x1cw É ü \x1cw;\x00 \x1cw" * 12), ("c", ".,;:!?\n\x0b\x0c\r")]
    assert collect(phrases.collocations(texts(spark, rows), minimum=3)) == ranked(rows, 3, 2000)


def test_ties_rank_by_bytes_and_top_cuts(spark):
    rows = [("a", f"{x} {y}. " * 5) for x, y in ("bB", "Zz", "éa", "zz", "\U0001f600b", "￭a")]
    got = collect(phrases.collocations(texts(spark, rows), minimum=5, top=4))
    assert got == ranked(rows, 5, 4) and [r[1] for r in got] == [1, 2, 3, 4]


def test_overlaps_and_covered_phrases(spark):
    rows = [("a", "w w w w w w w"), ("a", "m n o p. " * 10 + "m n. " * 2 + "o p q"), ("b", "only here " * 3)]
    assert collect(phrases.collocations(texts(spark, rows), minimum=2)) == ranked(rows, 2, 2000)


def test_empty_and_clashing_columns(spark):
    none = texts(spark, [])
    assert collect(phrases.collocations(none)) == []
    assert collect(phrases.collocations(texts(spark, [("a", None), (None, "")]))) == []
    rows = [("a", "k n k n k n"), (None, "a l r")]
    extra = spark.createDataFrame([(*r, 1, "n", "p", 2.0) for r in rows],
                                  "lang string, text string, k int, n string, phrase string, score double")
    assert collect(phrases.collocations(extra, minimum=2)) == ranked(rows, 2, 2000)


def test_products_beyond_64_bits(spark):
    """The score's arithmetic on counts near 2^63."""
    big = (1 << 63) - 1
    row = spark.range(1).selectExpr(
        f"CAST({big} AS BIGINT) AS a", f"CAST({big} AS BIGINT) AS l", f"CAST({big - 5} AS BIGINT) AS r")
    assert row.select(phrases.exact_score("a", "l", "r")).first()[0] == 2000000 * big // (big + big - 5)


def test_filter_has_every_phrase_put_in(spark):
    import numpy as np
    import pyarrow as pa
    rows = [(lang, p) for lang in ("a", "", "ü") for p in ("w", "w w", "w x y", "é", "a" * 500)]
    f = phrases.filter_of(spark.createDataFrame(rows, "lang string, phrase string"))()
    for lang, p in rows:
        bundle = phrases.Bundle(pa.array([lang]), pa.array([p]))
        h = bundle.hashed()
        code = h[:1]
        for k in range(1, len(h)):
            code = phrases._extended(code, h[k:k + 1])
        assert f.has(code).all(), (lang, p)
    misses = f.has(np.arange(1, 100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert misses.mean() < 0.01
