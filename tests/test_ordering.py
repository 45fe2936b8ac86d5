"""Row numbers and selections over keys of any type, ranges by search, dictionary merges."""
import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from stanceflow.operators import metrics as M
from stanceflow.operators.align import align_by_position
from stanceflow.operators.index import assign_batches
from stanceflow.operators.labels import head_limit
from stanceflow.operators.ordering import LOCAL_BITS, dealt, first_n, number_rows
from stanceflow.operators.text import normalize_tokens_by

KEYS = {
    "string": ["b", None, "", "a", "é", "￭", "\U0001f600", "a", "b"],
    "double": [1.5, None, float("nan"), -0.0, 0.0, float("-inf"), float("inf"), 2.0, 1.5],
    "decimal(20,2)": [decimal.Decimal(x) if x else None for x in ("1.20", None, "-7", "99999999999999999.99", "0.01", "1.2")],
    "date": [datetime.date(2020, 1, d) for d in (5, 1, 9)] + [None, datetime.date(1890, 1, 1)],
    "timestamp": [datetime.datetime(2020, 1, d) for d in (5, 1, 9, 9)] + [None],
    "binary": [b"b", b"", b"\xff", None, b"a"],
    "boolean": [True, None, False, True],
    "bigint": [(1 << 62), -(1 << 62), 0, None, 7, 7],
}


def keyed(spark, kind):
    values = [(i, v) for i, v in enumerate(KEYS[kind] * 5)]
    return spark.createDataFrame(values, f"id long, k {kind}").repartition(3, "id")


@pytest.mark.parametrize("kind", sorted(KEYS))
@pytest.mark.parametrize("descending", [False, True])
def test_numbers_and_selection_follow_sparks_order(spark, kind, descending):
    df = keyed(spark, kind)
    order = F.col("k").desc_nulls_last() if descending else F.col("k").asc_nulls_first()
    want = [r.id for r in df.orderBy(order, "id").collect()]
    got = number_rows(df, [("k", descending)], tie_break=["id"], partitions=5).orderBy("idx").collect()
    assert [r.id for r in got] == want and [r.idx for r in got] == list(range(len(want)))
    for n in (1, 6, len(want) - 1, len(want), len(want) + 9):
        picked = first_n(df, n, [("k", descending), "id"], in_one_task=2, cuts=4).collect()
        assert sorted(r.id for r in picked) == sorted(want[:n]), n


def test_one_value_is_dealt_out(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.lit("same").alias("k"), F.col("id").alias("v"))
    got = number_rows(df, ["k"], partitions=8)
    assert got.agg(F.min("idx"), F.max("idx"), F.count_distinct("idx")).first()[:] == (0, 19_999, 20_000)
    ranges = F.shiftrightunsigned("place", LOCAL_BITS)
    sizes = [r[0] for r in dealt(df, [F.col("k")], "place", 8).groupBy(ranges).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 6000
    assert first_n(df, 7777, ["k"], in_one_task=10).count() == 7777
    identical = spark.range(500).select(F.lit(None).cast("string").alias("k"))
    assert first_n(identical, 321, [("k", True)], in_one_task=10).count() == 321


def test_groups_ties_names_and_empty_frames(spark):
    rows = [("a", "x", 1), ("a", "x", 2), (None, "x", 3), (None, None, 4), ("b", "y", 5), ("a", "w", 6)]
    df = spark.createDataFrame(rows, "g string, k string, _spread int")
    got = {r["_spread"]: r.idx for r in number_rows(df, ["k"], partition_by=["g"], tie_break=["_spread"]).collect()}
    assert got == {6: 0, 1: 1, 2: 2, 4: 0, 3: 1, 5: 0}
    none = df.where(F.lit(False))
    assert number_rows(none, ["k"], partition_by=["g"]).count() == 0
    assert first_n(none, 5, ["k"], in_one_task=1).count() == 0
    same = spark.createDataFrame([("z",)] * 7, "k string")
    assert sorted(r.idx for r in number_rows(same, ["k"]).collect()) == list(range(7))


def test_selection_runs_without_a_single_large_task(spark):
    """The plan of a large first-n is a filter and a small top-n."""
    df = spark.range(0, 50_000, 1, 4).select(F.md5(F.col("id").cast("string")).alias("k"))
    got = first_n(df, 25_000, ["k"], in_one_task=500)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan or int(plan.split("LocalLimit ")[1].split()[0].rstrip(",")) <= 500
    assert sorted(r.k for r in got.collect()) == sorted(r.k for r in df.collect())[:25_000]


def test_large_head_limit_and_sort_expressions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10).alias("k"))
    want = sorted((9 - i % 10, i) for i in range(1000))[:345]
    assert sorted((9 - r.k, r.id) for r in head_limit(df, 345, [("k", True), "id"], in_one_task=20).collect()) == want
    got = head_limit(df, 345, [F.col("k").desc(), F.col("id")], in_one_task=20).collect()
    assert sorted((9 - r.k, r.id) for r in got) == want


def test_alignment_and_batches_by_string_keys(spark):
    left = spark.createDataFrame([("c", 1), ("a", 2), ("b", 3)], "name string, v int")
    right = spark.createDataFrame([("x1", "p"), ("x3", "r"), ("x2", "q"), ("x4", "s")], "file string, w string")
    got = {(r.v, r.r_w) for r in align_by_position(left, right, "name", "file", "full_outer").collect()}
    assert got == {(2, "p"), (3, "q"), (1, "r"), (None, "s")}
    batches = {r.name: (r.batch_pos, r.batch) for r in assign_batches(left, 2, "name").collect()}
    assert batches == {"a": (0, 0), "b": (1, 0), "c": (2, 1)}


@pytest.mark.parametrize("searched", [100_000, 2])
def test_rows_find_their_range(spark, searched):
    """Gaps, empty ranges, ranges over block borders, rows before and after all."""
    ranges = [("a", 3, 10), ("e", 10, 10), ("b", 10, 65_536), ("c", 70_000, 70_001), ("d", 131_072, 200_000)]
    table = spark.createDataFrame(ranges, "range_name string, lo int, hi int")
    idx = [0, 2, 3, 9, 10, 65_535, 65_536, 69_999, 70_000, 70_001, 131_071, 131_072, 199_999, 200_000]
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in idx], "idx long, y int, p int")
    got = {r.idx: r.range_name for r in M.with_range(df, table, searched=searched).collect()}
    assert got == {i: name for i in idx for name, lo, hi in ranges if lo <= i < hi}
    assert M.with_range(df, table.where(F.lit(False)), searched=searched).count() == 0


def test_range_scores_equal_target_scores(spark):
    rows = [(f"t{i % 7}" if i % 11 else None, i, i % 3, (i * 5) % 4 - 1) for i in range(400)]
    df = spark.createDataFrame(rows, "target string, id long, y int, p int")
    indexed = number_rows(df, ["target"], tie_break=["id"])
    got = {r.range_name: (r.n_rows, r.f1) for r in M.f1_by_range_table(indexed, M.ranges_by_target(df)).collect()}
    assert got == {r.target: (r.n_rows, r.f1) for r in M.f1_per_target(df).collect()}


def test_dictionary_hits_merge_in_place(spark):
    words = {"u": "you", "gr8": "really great", "rt": "", "end": "the end"}
    dictionary = spark.createDataFrame(list(words.items()), "slang string, expansion string")
    lists = [["u"], ["x", "u", "y", "rt", "z"], ["rt", "rt"], [], ["end", "a", "gr8", "end"], ["none", "here"], None,
             ["u", "x"] * 10_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "id int, tokens array<string>")
    got = {r.id: r.norm_tokens for r in normalize_tokens_by(df, dictionary).collect()}
    assert got == {i: None if t is None else [w for x in t for w in (words[x].split() if x in words else [x])]
                   for i, t in enumerate(lists)}


def test_a_text_of_hits_alone_is_linear(spark):
    import time
    dictionary = spark.createDataFrame([("a", "b c")], "slang string, expansion string")
    took = []
    for n in (20_000, 20_000, 160_000):
        df = spark.range(1).select(F.array_repeat(F.lit("a"), n).alias("tokens"))
        start = time.time()
        assert normalize_tokens_by(df, dictionary).select(F.size("norm_tokens")).first()[0] == 2 * n
        took.append(time.time() - start)
    assert took[2] < 8 * max(took[1], 0.5) * 2
