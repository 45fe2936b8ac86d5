"""Prompt rendering, the generation hook, streaming and the classifier."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stanceflow.functions.prompts import LLM_TEMPLATES, placeholders, render
from stanceflow.operators import metrics as M
from stanceflow.operators import model as MD
from stanceflow.operators import prompts as G
from stanceflow.plans.views import generation_view
from stanceflow.streaming import stream as ST


def test_template_contract(spark):
    assert placeholders(LLM_TEMPLATES["chat-type3"]) == {"text", "target"}
    with pytest.raises(KeyError):
        render(LLM_TEMPLATES["chat-type1"], {"text": "text"})
    df = spark.createDataFrame([("$target x", "T")], "text string, target string")
    got = df.select(render("A $text B ${target} $$", {"text": "text", "target": "target", "extra": "text"})
                    .alias("p")).first()["p"]
    assert got == "A $target x B T $"          # single pass: the inserted text is not substituted again


def test_sft_truncation_flags_lost_answer(spark):
    df = spark.createDataFrame([(" ".join(["w"] * 50), "T", "FAVOR")], "text string, target string, stance string")
    sft = G.build_sft(df)
    assert sft.first()["text"].endswith("[/INST] FAVOR</s>")
    assert G.truncate_sft(sft, max_len=4096).first()["answer_survived"]
    assert not G.truncate_sft(sft, max_len=40).first()["answer_survived"]


def test_generate_and_strip(spark):
    df = spark.createDataFrame([(i, "prompt %d" % i) for i in range(10)], "doc_id long, prompt string")

    def fn(pdf: pd.DataFrame) -> pd.Series:
        return pdf["prompt"] + " then prompt " + pdf["prompt"]

    out = G.strip_echo(G.generate(df, fn, ["prompt"], batch_size=3)).orderBy("doc_id").collect()
    assert out[0]["generated_text"] == " then prompt "
    empty = spark.createDataFrame([("", "abc")], "prompt string, generated_text string")
    assert G.strip_echo(empty).first()["generated_text"] == "abc"
    assert G.gen_log(empty).first()["log_line"] == "Generated text: abc"


def test_streaming_available_now_matches_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    gv = generation_view(spark, SF_SMALL)
    gv.repartition(3).write.parquet(src)
    parsed = ST.parsed_stream(ST.read_generation_stream(spark, src, max_files_per_trigger=1))
    ST.run_available_now(parsed.select("doc_id", "generated_stance", "p"), os.path.join(tmp_dir, "out"),
                         os.path.join(tmp_dir, "ck1"))
    streamed = {r["doc_id"]: r["p"] for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()}
    batch = {r["doc_id"]: r["p"] for r in ST.parsed_stream(gv).collect()}
    assert streamed == batch
    counts = ST.running_confusion(ST.parsed_stream(ST.read_generation_stream(spark, src, 1)))
    sink = os.path.join(tmp_dir, "f1")
    ST.run_counters_available_now(counts, os.path.join(tmp_dir, "ck2"), sink)
    last = spark.read.parquet(sink)
    final = last.join(last.groupBy("target").agg(F.max("batch_id").alias("batch_id")), ["target", "batch_id"])
    expected = {r["target"]: r["f1"] for r in M.f1_per_target(ST.parsed_stream(gv)).collect()}
    assert {r["target"]: pytest.approx(r["f1"]) for r in final.collect()} == expected


def test_classifier_learns_planted_signal(spark):
    rows = []
    for i in range(300):
        y = i % 3
        word = ["bad", "meh", "good"][y]
        rows.append((i, ["the", word, "x%d" % (i % 7)], ["topic"], y))
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>, target_tokens array<string>, y int")
    model = MD.train_classifier(df.filter(F.col("doc_id") % 5 != 0), max_iter=30)
    scored = MD.score_classifier(model, df.filter(F.col("doc_id") % 5 == 0))
    acc = M.accuracy(scored).first()["accuracy"]
    assert acc > 0.9


def test_batch_scorer_hook(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(7)], "doc_id long, x double")

    def fn(pdf):
        return [[v, 1.0, -v] for v in pdf["x"]]

    out = M.predict_label(MD.score_batches(df, fn, ["x"], batch_size=2), "logits")
    got = {r["doc_id"]: r["p"] for r in out.collect()}
    assert got[0] == 1 and got[5] == 0


def test_generate_checkpointed_is_stable(spark):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, "p%d" % i) for i in range(6)], "doc_id long, prompt string")

    def fn(pdf):
        return pdf["prompt"] + "!"

    out = G.generate(df, fn, ["prompt"], checkpoint=True)
    first = sorted(r["generated_text"] for r in out.collect())
    assert first == sorted(r["generated_text"] for r in out.collect()) == ["p%d!" % i for i in range(6)]
    assert calls.value == 0
