"""Metric edge cases checked by hand."""

import pytest
from pyspark.sql import functions as F

from stanceflow.operators import metrics as M


def _df(spark, pairs, extra=None):
    rows = [(y, p) for y, p in pairs]
    return spark.createDataFrame(rows, "y int, p int")


def test_f1_hand_computed(spark):
    df = _df(spark, [(0, 0), (0, 2), (2, 2), (1, 1), (1, 0), (2, -1)])
    prf = {r["cls"]: r for r in M.class_prf(df).collect()}
    # class 0: tp 1, predicted 2, true 2 -> F1 0.5; class 2: tp 1, pred 2, true 2 -> 0.5
    assert prf[0]["f1"] == pytest.approx(0.5) and prf[2]["f1"] == pytest.approx(0.5)
    assert prf[1]["precision"] == 1.0 and prf[1]["recall"] == 0.5
    assert M.f1_avg2(df).first()["f1_avg2"] == pytest.approx(0.5)
    assert M.f1_avg3(df).first()["f1_avg3"] == pytest.approx((0.5 + 2 / 3 + 0.5) / 3)


def test_micro_without_labels_is_accuracy(spark):
    df = _df(spark, [(0, 0), (1, 2), (2, 2), (1, -1)])
    assert M.f1_micro(df).first()["micro_f1"] == pytest.approx(0.5)
    assert M.accuracy(df).first()["accuracy"] == pytest.approx(0.5)
    lab = M.f1_micro(df, labels=[0, 1, 2]).first()
    assert lab["micro_precision"] == pytest.approx(2 / 3) and lab["micro_recall"] == pytest.approx(0.5)


def test_macro_present_vs_fixed(spark):
    # class 1 absent from y and p; -1 present in p
    df = _df(spark, [(0, 0), (2, 2), (2, -1)])
    a = M.f1_macro(df).first()["macro_f1"]
    b = M.f1_macro(df, labels=[0, 1, 2]).first()["macro_f1"]
    f0, f2 = 1.0, 2 * 1 / (1 + 2)
    assert a == pytest.approx((f0 + f2 + 0.0) / 3)      # classes 0, 2, -1 present
    assert b == pytest.approx((f0 + 0.0 + f2) / 3)      # class 1 counted as 0


def test_all_unknown_predictions(spark):
    df = _df(spark, [(0, -1), (1, -1), (2, -1)])
    assert M.f1_avg2(df).first()["f1_avg2"] == 0.0
    assert M.f1_micro(df, labels=[0, 1, 2]).first()["micro_f1"] == 0.0


def test_best_checkpoint_rules(spark):
    rows = [("r1", 1, 0.0), ("r1", 2, 0.0), ("r2", 1, 0.4), ("r2", 2, 0.6), ("r2", 3, 0.6), ("r3", 1, 0.2)]
    df = spark.createDataFrame(rows, "run string, epoch int, f1 double")
    best = {r["run"]: r["epoch"] for r in M.best_checkpoint(df, ["run"]).collect()}
    assert best == {"r2": 2, "r3": 1}        # r1 never above 0 keeps none; ties -> first epoch


def test_early_stop(spark):
    rows = [("a", 1, 0.9), ("a", 2, 0.8), ("a", 3, 0.85), ("a", 4, 0.7), ("b", 1, 0.5), ("b", 2, 0.5)]
    df = spark.createDataFrame(rows, "run string, epoch int, eval_loss double")
    p1 = {r["run"]: (r["stop_epoch"], r["best_epoch"]) for r in M.early_stop(df, ["run"], patience=1).collect()}
    assert p1 == {"a": (3, 2), "b": (2, 1)}
    p2 = {r["run"]: (r["stop_epoch"], r["best_epoch"]) for r in M.early_stop(df, ["run"], patience=2).collect()}
    assert p2 == {"a": (4, 4), "b": (2, 1)}


def test_argmax_ties_lowest_index(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0, 1.0, 0.0],)], "logits array<double>")
    got = [r["p"] for r in M.predict_label(df, prob_out="prob").collect()]
    assert got == [1, 0]
    probs = M.predict_label(df, prob_out="prob").first()["prob"]
    assert sum(probs) == pytest.approx(1.0)


def test_ranges_short_and_empty(spark):
    df = spark.createDataFrame([(i, i % 3, i % 3) for i in range(10)], "idx long, y int, p int")
    out = {r["range_name"]: (r["n_rows"], r["f1"]) for r in
           M.f1_by_ranges(df, [("a", 0, 4), ("b", 4, 100), ("c", 100, 200)]).collect()}
    assert out["a"][0] == 4 and out["b"][0] == 6 and out["c"] == (0, 0.0)


def test_seed_summary_and_wide(spark):
    rows = [("t", s, v) for s, v in [(1, 0.2), (2, 0.4), (3, 0.9)]]
    df = spark.createDataFrame(rows, "target string, seed int, value double")
    s = {r["seed"]: r["value"] for r in M.seed_summary(df, ["target"]).collect()}
    assert s[None] == pytest.approx(0.5)
    w = M.results_wide(df, ["target"], first_column=27).first()
    assert w["column"] == "AA" and w["mean"] == pytest.approx(0.5)


def test_column_letters(spark):
    df = spark.createDataFrame([(n,) for n in (1, 26, 27, 52, 53, 702, 703, 18_278, 18_279)], "n int")
    got = [r["c"] for r in df.select(M.column_letter(F.col("n")).alias("c")).collect()]
    assert got == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ", "AAAA"]


def test_score_summary_population_std_and_null_columns(spark):
    rows = [("lime", "e0", 1.0), ("lime", "e0", 3.0), ("shap", "e1", 2.0)]
    df = spark.createDataFrame(rows, "explainer string, evaluator string, score double")
    out = M.score_summary(df, "explainer", "evaluator", "score", ["e0", "e1", "e2"])
    assert "e2" not in out.columns
    std = {r["explainer"]: r["e0"] for r in out.filter("stat = 'std'").collect()}
    assert std["lime"] == pytest.approx(1.0)


def test_evaluate_policies(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 2, 2), ("b", 1, 0), ("b", 2, 2)], "target string, y int, p int")
    got = {(r["scope"], r["name"]): r["value"] for r in M.evaluate(df, "Covid19", per_target=True).collect()}
    assert ("overall", "avg3") in got and ("target", "a") in got
    vast = {r["name"] for r in M.evaluate(df, "vast", aux_eval=True, metric="macro", per_target=True).collect()}
    assert {"Against", "None", "Favor", "macro"} <= vast
    plain = M.evaluate(df, "vast", per_target=True).collect()
    assert [(r["scope"], r["name"]) for r in plain] == [("overall", "avg2")]


def test_score_tables_drop_independently(spark):
    rows = [("lime", "e0", 1.0), ("lime", "e0", 3.0), ("shap", "e1", 2.0), ("shap", "e2", None)]
    df = spark.createDataFrame(rows, "explainer string, evaluator string, score double")
    mean, std = M.score_tables(df, "explainer", "evaluator", "score", ["e0", "e1", "e2"])
    assert mean.columns == ["explainer", "e0", "e1"] and std.columns == ["explainer", "e0", "e1"]
    got = {r["explainer"]: r["e0"] for r in std.collect()}
    assert got["lime"] == pytest.approx(1.0)


def test_results_wide_takes_the_seeds_present(spark):
    rows = [("a", s, float(s)) for s in (1, 2, 3, 4)] + [("b", 1, 1.0), ("b", 2, 3.0)]
    df = spark.createDataFrame(rows, "target string, seed int, value double")
    got = {r["target"]: r for r in M.results_wide(df, ["target"], seeds=(1, 2, 3, 4)).collect()}
    assert got["a"]["mean"] == pytest.approx(2.5) and got["a"]["seed_4"] == 4.0
    assert got["b"]["mean"] == pytest.approx(2.0) and got["b"]["seed_3"] is None
    with pytest.raises(Exception, match="seed not listed: 4"):
        M.results_wide(df, ["target"]).collect()


def test_unlisted_evaluator_raises(spark):
    df = spark.createDataFrame([("lime", "e0", 1.0), ("lime", "e9", 3.0)],
                               "explainer string, evaluator string, score double")
    with pytest.raises(Exception, match="evaluator not listed: e9"):
        M.score_summary(df, "explainer", "evaluator", "score", ["e0"])


def test_macro_counts_every_class_present(spark):
    df = spark.createDataFrame([(0, 0), (2, 2), (2, 3), (3, 0)], "y int, p int")
    f1 = {0: 2 / 3, 2: 2 / 3, 3: 0.0}
    assert M.f1_macro(df).first()["macro_f1"] == pytest.approx(sum(f1.values()) / 3)


def test_aux_scope_is_vast_only(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 2, 2)], "target string, y int, p int")
    other = M.evaluate(df, "SemEval2016", aux_eval=True, per_target=True).collect()
    assert {r["name"] for r in other if r["scope"] == "target"} == {"a", "b"}
    assert not [r for r in other if r["scope"] == "class"]
