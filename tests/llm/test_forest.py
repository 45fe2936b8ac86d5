import re

import numpy as np
from llm_help import SF

from stanceflow.llm import forest

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows
          if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    return {i: sorted(((-float(x @ v), j) for j, x in ok if j != i))[:k] for i, v in ok if i % every == 0}


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    hits = 0
    got = forest.search(df).collect()
    for r in got:
        exact = {j: -s for s, j in want[r.query_id]}
        if r.vec_id in exact:
            hits += 1
            assert abs(exact[r.vec_id] - r.score) < 1e-12
    assert hits >= 0.9 * sum(map(len, want.values()))
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r)
    for rows in by.values():
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)


def test_pieces_give_the_same_answer(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").limit(300)
    a, b = (sorted((r.query_id, r.vec_id) for r in forest.search(df, piece=p).collect()) for p in (65_536, 64))
    assert a == b


def test_query_blocks_bound_the_groups(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").limit(300)
    a, b = (forest.search(df, every=2, piece=64, block=n) for n in (65_536, 8))
    assert sorted((r.query_id, r.rank, r.vec_id) for r in a.collect()) \
        == sorted((r.query_id, r.rank, r.vec_id) for r in b.collect())
    # both cogroups are keyed by piece and block of queries, with all trees inside
    plan = b._jdf.queryExecution().analyzed().toString()
    cogroups = [line for line in plan.split("\n") if "CoGroupsInArrow" in line]
    assert len(cogroups) == 2 and all(re.search(r"size#\d+, piece#\d+, block#\d+", line) for line in cogroups)


def test_many_ties_at_the_edge(spark):
    """More equal scores than are kept: the smallest keys stay, in any cut."""
    rows = [(i, [1.0, float(i)], "x") for i in range(1, 400)] + [(1000, [1.0, 0.0], "x")]
    for piece, block in ((65_536, 65_536), (32, 1)):
        got = forest.search(spark.createDataFrame(rows, SCHEMA), every=1000, share=1e6, piece=piece, block=block)
        assert [r.vec_id for r in got.orderBy("rank").collect()] == list(range(1, 21))


def test_ties_repeats_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60, [0.0, 0.0]), (80, None), (100, [1.0, None]), (160, [2.0]),
            (120, [float("nan"), 1.0]), (140, [0.5, 0.5]), (161, [-1.0, 0.2]), (None, [1.0, 1.0]), (180, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    want = brute([r for r in rows if r[0] != 160])
    got = {}
    for r in forest.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [j for _, j in v] for q, v in want.items()}


def test_fewer_candidates_than_asked(spark):
    rows = [(i, [float(i % 7), 1.0], "x") for i in range(1, 12)] + [(20, [3.0, 1.0], "x")]
    assert forest.search(spark.createDataFrame(rows, SCHEMA)).count() == 11
    assert forest.search(spark.createDataFrame(rows[:0], SCHEMA)).count() == 0
    assert forest.search(spark.createDataFrame(rows[-1:], SCHEMA)).count() == 0


def test_each_length_among_its_own(spark):
    """Longer vectors, usable or not, take nothing from the others."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(i, rng.normal(size=6).tolist())
                                                                  for i in range(60, 100)]
    bad = [(200, [1.0, None] + [1.0] * 7), (220, [float("nan")] * 8), (240, [1.0] * 3000)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], SCHEMA)
    got = {}
    for r in forest.search(df, piece=32, block=2, share=1e6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows[:60]) | brute(rows[60:])
    assert len(got) == 5 and got == {q: [j for _, j in v] for q, v in want.items()}
