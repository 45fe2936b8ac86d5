import random

import numpy as np
import pytest
import xxhash
from llm_help import EDGES, documents, frame

from stanceflow.llm import simhash
from stanceflow.llm.components import components


def fingerprint(text):
    """By the definition, bit by bit."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def merged(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def points():
    """Clusters of fingerprints at small distances."""
    rng = np.random.default_rng(1)
    found = set()
    for base in rng.integers(0, 1 << 63, 25, dtype=np.uint64).tolist():
        for _ in range(20):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << bit
            found.add(x - (1 << 64) if x >> 63 else x)
    return sorted(found)


@pytest.fixture(scope="module")
def true_links(points):
    return {(a, b) for i, a in enumerate(points) for b in points[i + 1:]
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}


def test_links_are_all_found(spark, points, true_links):
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(df).collect()}
    assert got == true_links and len(got) > 500


def test_crowded_cells_keep_the_components(spark, points, true_links):
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    dense = [(r.a, r.b) for r in simhash.links(df, crowd=3, block=4).collect()]
    assert merged(points, dense) == merged(points, true_links)


def test_lookers_of_a_small_cell_beside_large_ones_are_cut(spark, monkeypatch):
    """A crowded cell whose neighbours hold many more: no group of its block
    join is larger than both sides' blocks, and the components stay."""
    rng = random.Random(3)
    around = (84, 81, 69, 21)  # halves that are one step below 85
    points = sorted({(h << 32) | rng.getrandbits(32) for h in (*around, 85) for _ in range(10 if h == 85 else 300)})
    points += [p ^ 1 for p in points[::7]]
    points = sorted(set(points))
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    plain, limit = simhash.forest, 2 * 16 + 40

    def checked(table, bits):
        if table.num_rows > limit:
            raise ValueError(f"a group of {table.num_rows} rows")
        return plain(table, bits)

    monkeypatch.setattr(simhash, "forest", checked)
    dense = [(r.a, r.b) for r in simhash.links(df, crowd=3, block=16).collect()]
    want = [(a, b) for i, a in enumerate(points) for b in points[:i] if (a ^ b).bit_count() <= 3]
    assert merged(points, dense) == merged(points, want)


def test_manhattan_bound_is_a_lower_bound(spark, points):
    from pyspark.sql import functions as F
    rows = list(zip(points, points[7:], strict=False))
    df = spark.createDataFrame(rows, "a long, b long").select(
        "a", "b", simhash.manhattan(simhash.counts(F.col("a")), simhash.counts(F.col("b"))).alias("d"))
    for r in df.collect():
        a, b = r.a & ((1 << 64) - 1), r.b & ((1 << 64) - 1)
        exact = sum(abs((a >> i & 3).bit_count() - (b >> i & 3).bit_count()) for i in range(0, 64, 2))
        assert r.d == exact <= (a ^ b).bit_count()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 600)] + [(7, 7), (1000, 7), (7, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = merged({n for e in edges for n in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_equal_brute_force(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(
        frame(spark, [(i + 1000, t) for i, t in EDGES if i is not None]))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [(i, fingerprint(t)) for i, t in rows]
    links = [(a, b) for n, (a, p) in enumerate(prints) for b, q in prints[n + 1:] if (p ^ q).bit_count() <= 3]
    roots = merged({i for i, _ in rows}, links)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.digest(docs).collect())
    assert got == sorted((i, f"{p:016x}", roots[i]) for i, p in prints)
    kept = simhash.one_per_group(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))


def test_edges(spark):
    docs = frame(spark, EDGES, extra=True)
    out = simhash.one_per_group(docs)
    assert out.columns == docs.columns
    # empty texts are one group, the repeated row is kept once, no key: kept
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 4, 5, 6, 7, 8]
    assert simhash.digest(frame(spark, [])).count() == 0
    assert simhash.one_per_group(frame(spark, [])).count() == 0


def test_unrelated_texts_of_one_key_all_stay(spark):
    def words(n):
        return " ".join(f"w{n}x{i}" for i in range(200))

    # 1 is copied by the second text of 5; the two texts of 7 are met nowhere else, one of them is repeated
    rows = [(1, words(1)), (5, words(2)), (5, words(1)), (7, words(3)), (7, words(4)), (7, words(4)), (None, words(1))]
    out = simhash.one_per_group(frame(spark, rows, extra=True)).collect()
    assert sorted(((r.doc_id or -1), r.text) for r in out) == sorted(
        [(-1, words(1)), (1, words(1)), (5, words(2)), (7, words(3)), (7, words(4))])
