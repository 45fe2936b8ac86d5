import pytest
from llm_help import EDGES, frame
from pyspark.sql import functions as F

from stanceflow.llm import mixing

BIG = "/root/testdata/sf0.01"


def test_margins_are_met(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = mixing.digest(docs).collect()
    assert len(rows) == docs.count()
    for dim in ("source", "lang", "topic"):
        own, got = {}, {}
        for r in rows:
            own[r[dim]] = own.get(r[dim], 0) + r.n_tokens
            got[r[dim]] = got.get(r[dim], 0) + r.n_tokens * r.weight
        goal = {c: t ** mixing.ALPHA for c, t in own.items()}
        for c in own:
            assert got[c] / sum(got.values()) == pytest.approx(goal[c] / sum(goal.values()), abs=1e-3)
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(mixing.KEEP * total, rel=1e-3)
    assert all(r.probability == pytest.approx(min(1.0, r.weight)) for r in rows)
    drawn = sum(r.n_tokens for r in rows if r.selected)
    assert drawn == pytest.approx(mixing.KEEP * total, rel=0.1)


def test_given_targets(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 40), ("b", "y", 20)],
                                  "source string, lang string, tokens long")
    goals = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.2, "y": 0.8}}
    rows = mixing.rake(cells, ["source", "lang"], "tokens", goals).collect()
    whole = sum(r.raked for r in rows)
    assert sum(r.raked for r in rows if r.source == "a") / whole == pytest.approx(0.5, abs=1e-3)
    assert sum(r.raked for r in rows if r.lang == "x") / whole == pytest.approx(0.2, abs=1e-3)
    # raking keeps the odds ratio of the cells
    w = {(r.source, r.lang): r.raked for r in rows}
    assert w["a", "x"] * w["b", "y"] / (w["a", "y"] * w["b", "x"]) == pytest.approx(10 * 20 / (30 * 40))


def test_categories_without_target_keep_their_share(spark):
    rows = [("a", "x", 10), ("a", "y", 30), ("b", "x", 40), ("b", "y", 20), ("c", "x", 500), ("c", "y", 300),
            (None, "x", 60), (None, "y", 40)]
    cells = spark.createDataFrame(rows, "source string, lang string, tokens long")
    goals = {"source": {"a": 0.25, "b": 0.75, "gone": 1.0}}
    out = mixing.rake(cells, ["source", "lang"], "tokens", goals).collect()
    whole = sum(r.raked for r in out)
    for source, share in (("a", 0.025), ("b", 0.075), ("c", 0.8), (None, 0.1)):
        assert sum(r.raked for r in out if r.source == source) / whole == pytest.approx(share, abs=1e-3)
    x, y = 610 ** mixing.ALPHA, 390 ** mixing.ALPHA
    assert sum(r.raked for r in out if r.lang == "x") / whole == pytest.approx(x / (x + y), abs=1e-3)


def test_targets_that_contradict_are_an_error(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 30)], "source string, lang string, tokens long")
    with pytest.raises(ValueError, match="not met"):
        mixing.rake(cells, ["source", "lang"], "tokens", {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.1, "y": 0.9}})


def test_draws_repeat_and_edges(spark):
    docs = frame(spark, EDGES, extra=True)
    a, b = (sorted(map(str, mixing.sampled(docs).collect())) for _ in range(2))
    assert a == b and mixing.sampled(docs).columns == docs.columns
    out = mixing.digest(docs)
    assert out.count() == len(EDGES)
    assert out.where(F.col("weight").isNull() | F.col("selected").isNull()).count() == 0
    assert mixing.digest(docs.limit(0)).count() == 0 and mixing.sampled(docs.limit(0)).count() == 0
