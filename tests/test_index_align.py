"""Distributed row index, positional alignment and perturbations."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stanceflow.operators import align as J
from stanceflow.operators import perturb as T
from stanceflow.operators.index import assign_batches, with_row_index, with_row_index_by
from stanceflow.operators.labels import head_limit
from stanceflow.session import checkpoint_dir


def test_index_dense_and_repeatable(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k").repartition(13)
    a = {r["k"]: r["idx"] for r in with_row_index(df, "k", slice_bits=4).collect()}
    b = {r["k"]: r["idx"] for r in with_row_index(df.repartition(3), "k", slice_bits=9).collect()}
    assert a == b and sorted(a.values()) == list(range(len(a)))
    assert all(a[k] == i for i, k in enumerate(sorted(a)))


def test_index_by_any_order(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "t string, n int")
    got = {r["t"]: r["idx"] for r in with_row_index_by(df, [(F.col("n"), True)], [(F.col("n"), True), (F.col("t"), False)]).collect()}
    assert got == {"c": 0, "a": 1, "b": 2, "d": 3}


def test_batches(spark):
    df = spark.range(70).withColumnRenamed("id", "k")
    b = {r["k"]: r["batch"] for r in assign_batches(df, 32, "k").collect()}
    assert Counter(b.values()) == {0: 32, 1: 32, 2: 6}
    s1 = {r["k"]: r["batch"] for r in assign_batches(df, 32, "k", shuffle_seed=3).collect()}
    s2 = {r["k"]: r["batch"] for r in assign_batches(df.repartition(5), 32, "k", shuffle_seed=3).collect()}
    assert s1 == s2 and Counter(s1.values()) == {0: 32, 1: 32, 2: 6}


def test_shuffle_keeps_multiset(spark):
    df = spark.createDataFrame([(i, "t%d" % (i % 4)) for i in range(40)], "k long, target string")
    out = T.shuffle_targets(df, "k", seed=1433).collect()
    assert Counter(r["target"] for r in out) == Counter(r["orig_target"] for r in out)
    assert any(r["target"] != r["orig_target"] for r in out)


def test_explicit_implicit_partition(spark):
    df = spark.createDataFrame([(1, "en", "the cat"), (2, "en", "a dog"), (3, "de", "der Hund")],
                               "k long, target string, text string")
    kw = spark.createDataFrame([("en", ["the"]), ("de", ["Hund"])], "target string, keywords array<string>")
    ex, im = T.explicit_split(df, kw)
    assert sorted(r["k"] for r in ex.collect()) == [1, 3] and [r["k"] for r in im.collect()] == [2]


def test_explicit_missing_keywords_raises(spark):
    df = spark.createDataFrame([(1, "fr", "le chat")], "k long, target string, text string")
    kw = spark.createDataFrame([("en", ["the"])], "target string, keywords array<string>")
    ex, _ = T.explicit_split(df, kw)
    try:
        ex.collect()
        raised = False
    except Exception as e:  # noqa: BLE001
        raised = "no keywords" in str(e)
    assert raised


def test_negate_flips_every_row(spark):
    df = spark.createDataFrame([(1, "en", 2), (2, "xx", 0), (3, "en", 1)], "k long, target string, y int")
    neg = spark.createDataFrame([("en", "not en")], "target string, negated string")
    got = {r["k"]: (r["target"], r["y"]) for r in T.negate_targets(df, neg).collect()}
    assert got == {1: ("not en", 0), 2: ("xx", 2), 3: ("not en", 1)}
    # repeated entries double no row, different ones are an error
    assert T.negate_targets(df, neg.union(neg)).count() == 3
    with pytest.raises(Exception, match="two negations of target en"):
        T.negate_targets(df, neg.union(spark.createDataFrame([("en", "un-en")], neg.schema))).collect()


def test_repeated_keyword_lists_count_together(spark):
    df = spark.createDataFrame([(1, "a cat", "t"), (2, "a dog", "t"), (3, "a cow", "t")], "k long, text string, target string")
    kw = spark.createDataFrame([("t", ["cat"]), ("t", ["dog"])], "target string, keywords array<string>")
    assert {r["k"]: r["explicit"] for r in T.explicit_flag(df, kw).collect()} == {1: True, 2: True, 3: False}


def test_mask_targets_test_split_only(spark):
    df = spark.createDataFrame([(1, "en", "test"), (2, "en", "train")], "k long, target string, split string")
    got = {r["k"]: r["target"] for r in T.mask_targets(df).collect()}
    assert got == {1: "", 2: "en"}


def test_alignment_audit_flags(spark):
    left = spark.createDataFrame([(i, "t%d" % i) for i in range(6)], "k long, text string")
    right = spark.createDataFrame([(i, "t%d" % i if i != 2 else "X", i % 2) for i in range(5)],
                                  "k long, post string, seen int")
    ign = spark.createDataFrame([(4,)], "idx long")
    r = J.alignment_audit(left, right, "k", "k", "text", "post", ignore=ign, seen="seen", expected_subset=3).first()
    assert (r["n_left"], r["n_right"], r["n_ignored"]) == (6, 5, 1)
    assert r["n_mismatch"] == 2 and not r["length_ok"] and r["subset_ok"]


def test_differing_positions(spark):
    n = 3000
    rows = [(i, None if i == 70 else "t%d" % i) for i in range(n)]
    other = [(i, {5: "x", 2900: None, 2901: "y"}.get(i, t)) for i, t in rows] + [(n, "more")]
    left = spark.createDataFrame(rows, "k long, text string")
    right = spark.createDataFrame(other, "q long, post string")
    got = sorted(tuple(r) for r in J.differing_positions(left, right, "k", "q", "text", "post", chunk=16).collect())
    assert got == [(5, 5, 5, "text"), (2900, 2900, 2900, "text"), (2901, 2901, 2901, "text"), (n, None, n, "right only")]
    ign = spark.createDataFrame([(5,), (n,)], "idx long")
    rest = J.differing_positions(left, right, "k", "q", "text", "post", ignore=ign, levels=3, chunk=4)
    assert sorted(r.idx for r in rest.collect()) == [2900, 2901]
    assert J.differing_positions(left, left, "k", "k", "text", "text").count() == 0
    none = J.differing_positions(left.limit(0), right.limit(2), "k", "q", "text", "post")
    assert sorted(tuple(r) for r in none.collect()) == [(0, None, 0, "right only"), (1, None, 1, "right only")]


def test_equal_chunks_are_skipped(spark):
    left = spark.range(4096).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("t"))
    right = left.withColumn("t", F.when(F.col("idx").isin(17, 3000), "x").otherwise(F.col("t")))
    for levels in (1, 2, 3):
        assert sorted(r.c for r in J.differing_chunks(left, right, levels, 16).collect()) == [1, 187]
    # two rows that change places differ, although the chunk holds the same texts
    moved = left.withColumn("t", F.when(F.col("idx") == 1, "2").when(F.col("idx") == 2, "1").otherwise(F.col("t")))
    assert [r.c for r in J.differing_chunks(left, moved, 2, 16).collect()] == [0]


def test_zero_shot_subset_renumbers(spark):
    parsed = spark.createDataFrame([(10 + i, "s%d" % i) for i in range(6)], "doc long, stance string")
    ref = spark.createDataFrame([(i, i % 2) for i in range(6)], "k long, seen int")
    out = J.zero_shot_subset(parsed, ref, "doc", "k", "seen").orderBy("new_idx").collect()
    assert [(r["new_idx"], r["doc"]) for r in out] == [(0, 10), (1, 12), (2, 14)]


def test_sweep_grid_dedupes_baseline(spark):
    g = T.sweep_grid(spark, [0.1, 0.2], ["0.50l_0.25h"], ["Bert", "Bertweet"], seeds=[1])
    rows = g.collect()
    assert len(rows) == 2 * (1 + 2 * 2)
    assert sum(1 for r in rows if not r["aware"]) == 2


def test_reads_documents(spark):
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    idx = with_row_index(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "doc_id")
    assert idx.agg(F.max("idx")).first()[0] == n - 1


def test_index_null_repeated_and_descending_keys(spark):
    rows = [(None, 0), (None, 1), *[(i // 2, i) for i in range(40)], (-70_000, 41), (1 << 40, 42)]
    df = spark.createDataFrame(rows, "k long, t int")
    up = [r["t"] for r in with_row_index(df, "k", tie_break=["t"]).orderBy("idx").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert up == [t for _, t in sorted(rows, key=key)]
    down = [r["t"] for r in with_row_index(df, "k", tie_break=["t"], descending=True).orderBy("idx").collect()]
    assert down == [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]


def test_index_per_group_with_null_groups(spark):
    df = spark.createDataFrame([("a", 5), (None, 3), ("a", 1), (None, 9), ("b", 2)], "g string, k long")
    got = {(r["g"], r["k"]): r["idx"] for r in with_row_index(df, "k", partition_by=["g"]).collect()}
    assert got == {("a", 1): 0, ("a", 5): 1, (None, 3): 0, (None, 9): 1, ("b", 2): 0}


def test_index_needs_an_integer_key(spark):
    with pytest.raises(TypeError):
        with_row_index(spark.createDataFrame([("a",)], "k string"), "k")


def test_index_plans_without_jobs_or_round_robin(spark):
    status = spark.sparkContext.statusTracker()
    before = len(status.getJobIdsForGroup())
    df = with_row_index(spark.range(1000).withColumnRenamed("id", "k"), "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and len(status.getJobIdsForGroup()) == before


@pytest.mark.parametrize("n", [1, 5, 20_000])
def test_head_limit_is_one_behaviour(spark, n):
    rows = [(None, "z"), (3, "a"), (1, "c"), (2, None), (7, "b")]
    df = spark.createDataFrame(rows, "k long, s string")
    by_key = [r["k"] for r in head_limit(df, n, "k").orderBy("k").collect()]
    assert by_key == [None, 1, 2, 3, 7][:n]
    down = {r["k"] for r in head_limit(df, n, F.col("k").desc()).collect()}
    assert down == set([7, 3, 2, 1, None][:n])
    text = {r["s"] for r in head_limit(df, n, "s").collect()}
    assert text == set([None, "a", "b", "c", "z"][:n])
    assert head_limit(df, 0, "k").count() == 5


def test_checkpoint_folder_is_required():
    class Context:
        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
