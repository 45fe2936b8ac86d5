"""File round trips for the sources (S1-S8) and sinks (K1-K6)."""

import csv
import json
import os

from pyspark.sql import functions as F

from stanceflow.sources import readers as S
from stanceflow.sources import sinks as K


def _write_csv(path, header, rows, encoding="utf-8", newline="\n"):
    with open(path, "w", encoding=encoding, newline="") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(header)
        w.writerows(rows)


def test_labelled_csv_positional_and_aux(spark, tmp_dir):
    p3 = os.path.join(tmp_dir, "three.csv")
    _write_csv(p3, ["Tweet", "Target", "Stance"], [["café \"quoted\", x", "Atheism", "AGAINST"],
                                                   ["line\nbreak", "Atheism", "FAVOR"]], encoding="iso-8859-1")
    df = S.read_labelled_csv(spark, p3, multiline=True)
    rows = df.orderBy("stance").collect()
    assert df.columns == ["text", "target", "stance", "target_id"]
    assert rows[0]["text"] == "café \"quoted\", x" and rows[0]["target_id"] == 1
    assert rows[1]["text"] == "line\nbreak"
    p4 = os.path.join(tmp_dir, "four.csv")
    _write_csv(p4, ["a", "b", "c", "d"], [["t", "x", "NONE", "7"]], newline="\r\n")
    assert S.read_labelled_csv(spark, p4, encoding="utf-8").first()["target_id"] == 7


def test_split_loader(spark, tmp_dir):
    for name in ("raw_train_all_onecol.csv", "raw_val_all_onecol.csv", "mytest.csv"):
        os.makedirs(os.path.join(tmp_dir, "ds"), exist_ok=True)
        _write_csv(os.path.join(tmp_dir, "ds", name), ["a", "b", "c"], [[name, "t", "FAVOR"]])
    df = S.load_splits(spark, tmp_dir, "ds", eval_file="mytest.csv")
    assert {r["split"]: r["text"] for r in df.collect()} == {
        "train": "raw_train_all_onecol.csv", "val": "raw_val_all_onecol.csv", "test": "mytest.csv"}


def test_nested_aspects_and_flat_sink(spark, tmp_dir):
    doc = [{"raw_words": "good food bad staff", "aspects": [{"term": ["food"], "polarity": "POS"},
                                                           {"term": ["bad", "staff"], "polarity": "NEG"},
                                                           {"term": ["food"], "polarity": "POS"}]},
           {"raw_words": "nothing here", "aspects": []}]
    p = os.path.join(tmp_dir, "a.json")
    with open(p, "w") as f:
        json.dump(doc, f)
    flat = S.flatten_aspects(S.read_aspect_json(spark, p, array=True))
    assert sorted((r["aspect"], r["polarity"]) for r in flat.collect()) == [
        ("bad staff", "NEG"), ("food", "POS"), ("food", "POS")]
    out = os.path.join(tmp_dir, "flat")
    K.write_flat_aspects(flat, out)
    assert spark.read.option("header", True).csv(out).count() == 2


def test_literal_list_cells(spark):
    cells = ["[{'term': 'room', 'polarity': 'neutral'}, {'term': 'bed', 'polarity': 'positive'}]",
             "[{'term': 'noaspectterm', 'polarity': 'none'}]"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, cell string")
    rows = sorted(S.parse_aspect_cell(df, "cell", keep=["i"]).collect(), key=lambda r: (r["i"], str(r["aspect"])))
    assert [(r["i"], r["aspect"], r["has_aspect"]) for r in rows] == [
        (0, "bed", True), (0, "room", True), (1, None, False)]


def test_unreadable_aspect_cells_are_set_aside(spark):
    item = "{'term': 'bed', 'polarity': 'positive'}"
    cells = [f"[{item}]", f"[{item}, {{'term'", "", None, "[]", "nonsense", f"[{item}, {{'term': 'x'}}]",
             "[{'term': 'noaspectterm', 'polarity': 'none'}]", f"[{item}", "[null]", "5"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, cell string")
    rows, bad = S.split_aspect_cells(df, "cell", keep=["i"])
    assert sorted((r["i"], r["aspect"]) for r in rows.collect()) == [(0, "bed"), (7, None)]
    item_reason = "item without term or polarity"
    assert {r["i"]: (r["cell"], r["reason"]) for r in bad.collect()} == {
        i: (cells[i], why) for i, why in {1: "no list", 2: "no list", 3: "missing cell", 5: "no list", 6: item_reason,
                                          8: "no list", 9: item_reason, 10: "no list"}.items()}


def test_generation_round_trip_and_parsed_sink(spark, tmp_dir):
    df = spark.createDataFrame([("t1", "x", "FAVOR", "p1", "[/INST] NONE"), ("t2", "x", "NONE", "p2", None)],
                               "text string, target string, stance string, prompt string, generated_text string")
    path = os.path.join(tmp_dir, "gen")
    K.write_generations(df, path)
    back = S.read_generations(spark, path)
    assert back.columns == list(S.GENERATION_COLUMNS)
    rows = {r["Tweet"]: r for r in back.collect()}
    assert rows["t2"]["Generated Text"] is None and rows["t1"]["Generated Stance"] is None
    parsed = back.withColumn("generated_stance", F.when(F.col("`Generated Text`").isNull(), "").otherwise("NONE"))
    n = K.write_parsed(parsed, os.path.join(tmp_dir, "parsed"), os.path.join(tmp_dir, "unmatched"))
    assert n == 1
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "unmatched")).count() == 1


def test_prediction_export_and_results(spark, tmp_dir):
    df = spark.createDataFrame([(1, ["a", "b"], ["x"], ["x"], 0, 2), (1, ["c"], ["y"], ["y"], 1, 1)],
                               "seed int, tokens array<string>, orig_target_tokens array<string>, "
                               "target_tokens array<string>, y int, p int")
    out = os.path.join(tmp_dir, "exp")
    K.export_predictions(df, out, only_errors=True, masked=True)
    rows = spark.read.option("header", True).csv(out).collect()
    assert len(rows) == 1 and rows[0]["New Target"] == "Target is Masked" and rows[0]["Pred Aspect"] == "POS"
    res = os.path.join(tmp_dir, "res")
    long = spark.createDataFrame([("d", 1, 0.5)], "dataset string, seed int, value double")
    K.append_results(long, res)
    K.append_results(long, res)
    assert spark.read.parquet(res).count() == 2
    scores = spark.createDataFrame([("mean", "lime", 1.0), ("std", "lime", 0.5)], "stat string, explainer string, e0 double")
    K.write_score_tables(scores, os.path.join(tmp_dir, "scores"))
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "scores")).count() == 2


def test_vectors_first_n(spark):
    from stanceflow.operators.pairs import read_vectors
    df = spark.createDataFrame([(i, "w%d" % i) for i in range(10, 0, -1)], "rank int, token string")
    assert sorted(r["rank"] for r in read_vectors(df, 3).collect()) == [1, 2, 3]
    assert read_vectors(df, 100).count() == 10


def test_large_first_n_uses_row_index(spark):
    from stanceflow.operators.labels import head_limit
    df = spark.range(0, 30000).withColumnRenamed("id", "rank").repartition(7)
    got = head_limit(df, 20000, "rank")
    assert got.count() == 20000 and got.agg({"rank": "max"}).first()[0] == 19999
    assert "TakeOrderedAndProject" not in got._jdf.queryExecution().executedPlan().toString()


def test_score_table_pair(spark, tmp_dir):
    from stanceflow.operators.metrics import score_tables
    rows = [("lime", "e0", 1.0), ("shap", "e1", 2.0)]
    df = spark.createDataFrame(rows, "explainer string, evaluator string, score double")
    mean, std = score_tables(df, "explainer", "evaluator", "score", ["e0", "e1", "e9"])
    K.write_score_table_pair(mean, std, os.path.join(tmp_dir, "scores"))
    back = spark.read.option("header", True).csv(os.path.join(tmp_dir, "scores", "mean"))
    assert back.columns == ["explainer", "e0", "e1"] and back.count() == 2


def test_dictionary_readers(spark, tmp_dir):
    j, t = os.path.join(tmp_dir, "d.json"), os.path.join(tmp_dir, "d.tsv")
    with open(j, "w") as f:
        json.dump({"u": "you", "b4": "before", "lol": ""}, f, indent=1)
    with open(t, "w") as f:
        f.write("u\tyou \"all\" \nidk\ti do not know\n")
    assert {tuple(r) for r in S.read_dictionary_json(spark, j).collect()} == {
        ("u", "you"), ("b4", "before"), ("lol", "")}
    assert {tuple(r) for r in S.read_dictionary_tsv(spark, t).collect()} == {
        ("u", 'you "all"'), ("idk", "i do not know")}


def test_labelled_rows_from_json_lines_and_parquet(spark, tmp_dir):
    rows = [{"a_text": "x", "b_target": "t", "c_label": "FAVOR"}]
    p = os.path.join(tmp_dir, "rows.jsonl")
    with open(p, "w") as f:
        f.write("\n".join(map(json.dumps, rows)))
    q = os.path.join(tmp_dir, "rows.parquet")
    spark.read.json(p).write.parquet(q)
    for path in (p, q):
        assert tuple(S.read_labelled_csv(spark, path).first()) == ("x", "t", "FAVOR", 1)
