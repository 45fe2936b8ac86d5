"""Tokeniser, marker removal and dictionary normalisation edge cases, and
parity with Python's ``re`` over whole documents."""

import re

import pytest

from conftest import SF_SMALL
from stanceflow.functions.text import (
    TOKEN_PATTERN, clean_aspect_tokens, clean_stance_tokens, normalize_tokens, tokenize,
)
from stanceflow.operators import text as T


def _tokens(spark, text, fn=clean_aspect_tokens):
    return spark.createDataFrame([(text,)], "t string").select(fn("t").alias("x")).first()["x"]


def test_markers_and_case(spark):
    toks = _tokens(spark, "#SemST #semst #SEMST #SemSTx", lambda c: clean_stance_tokens(c))
    assert toks == ["#semst", "x"]


def test_backslash_and_accents_split(spark):
    assert _tokens(spark, "cafés 12ab") == ["caf", "s", "12", "ab"]
    assert _tokens(spark, "a\\b") == ["a", "b"]
    assert _tokens(spark, "café") == ["caf"]
    assert _tokens(spark, "x,y!?&/<>=$z") == ["x", ",", "y", "!", "?", "&", "/", "<", ">", "=", "$", "z"]


def test_separators_only_and_null(spark):
    assert _tokens(spark, " ;:-_ ") == []
    assert _tokens(spark, None) == []
    assert _tokens(spark, "") == []


def test_reserved_words_and_urls(spark):
    toks = _tokens(spark, "RT @user: see https://x.co/a?b=1 FAV fav", lambda c: clean_stance_tokens(c))
    assert toks == ["@user", "see", "fav"]
    toks = _tokens(spark, "RT2020 ÉRT FAVÉ RT_x HTTP://a.b/c RT RT\nFAV", lambda c: clean_stance_tokens(c))
    assert toks == ["rt", "2020", "rt", "fav", "rt", "x"]


def test_dictionary_single_pass(spark):
    pairs = [("a", ""), ("b", "c  d"), ("c", "zz"), ("e", "B")]
    df = spark.createDataFrame([(["a", "b", "c", "e", "q"],)], "t array<string>")
    got = df.select(normalize_tokens("t", pairs).alias("x")).first()["x"]
    # blank removes, two words expand, a value that is a key is not re-mapped,
    # and values are not lowered again
    assert got == ["c", "d", "zz", "B", "q"]


def test_merge_dicts_override_wins(spark):
    base = spark.createDataFrame([("en", "in"), ("the", "teh of")], "slang string, expansion string")
    over = spark.createDataFrame([("en", "inn  "), ("x", "y")], "slang string, expansion string")
    got = {r["slang"]: r["expansion"] for r in T.merge_dicts(base, over).collect()}
    assert got == {"en": "inn", "the": "teh of", "x": "y"}


def test_normalize_join_equals_map(spark):
    pairs = [("the", "teh of"), ("la", ""), ("en", "inn")]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", clean_aspect_tokens("text").alias("t"))
    d = spark.createDataFrame(pairs, "slang string, expansion string")
    a = {r["doc_id"]: r["x"] for r in docs.select("doc_id", normalize_tokens("t", pairs).alias("x")).collect()}
    b = {r["doc_id"]: r["n"] for r in T.normalize_join(docs, d, "doc_id", "t", "n").collect()}
    assert a == b


def test_tokenizer_parity_with_python_re(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text", tokenize("text").alias("t")).collect()
    pat = re.compile(r"[A-Za-z#@]+|[,.!?&/\<>=$]|[0-9]+")
    bad = [r for r in docs if pat.findall(r["text"]) != r["t"]]
    assert not bad and TOKEN_PATTERN


def test_cap_and_profile(spark):
    df = spark.createDataFrame([(["a"] * 130,), (["b"] * 5,)], "tokens array<string>")
    capped = T.cap_tokens(df, "tokens", 100).collect()
    assert [len(r["tokens"]) for r in capped] == [100, 5]
    prof = T.length_profile(df, [], "tokens", "Covid19").first()
    assert prof["max_len"] == 130 and prof["avg_len"] == 52.5 and prof["n_over_cap"] == 1 and not prof["overflow"]
    prof2 = T.length_profile(df, [], "tokens", "SemEval2016").first()
    assert prof2["overflow"] and prof2["avg_len"] == 67.5


def test_dictionary_join_is_safe_on_keys(spark):
    d = spark.createDataFrame([("a", "c z"), ("b", ""), ("q", None), ("a", "d"), (None, "x")],
                              "slang string, expansion string")
    rows = [(1, ["a"]), (1, ["b"]), (1, ["a"]), (None, ["x", "a", "q"]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    got = sorted(map(str, T.normalize_join(df, d, "id", "t", "n").collect()))
    want = [(1, ["c", "z"]), (1, []), (1, ["c", "z"]), (None, ["x", "c", "z"]), (2, []), (3, None)]
    assert got == sorted(f"Row(id={i}, n={n})" for i, n in want)


def test_clean_stance_takes_a_dictionary_frame(spark):
    df = spark.createDataFrame([("U are RT here", "U too")], "text string, target string")
    d = spark.createDataFrame([("u", "you all"), ("too", "")], "slang string, expansion string")
    a = T.clean_stance(df, d).first()
    b = T.clean_stance(df, [("u", "you all"), ("too", "")]).first()
    assert a == b and a["tokens"] == ["you", "all", "are", "here"] and a["target_tokens"] == ["you", "all"]


def test_long_literal_dictionary_is_refused(spark):
    with pytest.raises(ValueError, match="DataFrame"):
        normalize_tokens("t", [(str(i), "x") for i in range(100)])


def test_dictionary_rows_stay_where_they_are(spark, monkeypatch):
    """A dictionary that fits is looked up in place; joined or looked up, the
    lists are those of a plain loop."""
    lists = [["a", "b", "a"], [], None, [None, "a"], ["a"], ["zz", "b", "c"], ["é", "b"], ["a", "b", "a"]]
    entries = [("a", "x y"), ("a", "x  z"), ("b", " "), ("c", None), (None, "q"), ("é", "\U0001f600"), ("nowhere", "n")]
    d = spark.createDataFrame(entries, "slang string, expansion string")
    df = spark.createDataFrame(list(enumerate(lists)), "id int, t array<string>").repartition(3)
    known = {"a": ["x", "z"], "b": [], "c": [], "é": ["\U0001f600"]}
    want = {i: None if x is None else [w for t in x for w in known.get(t, [t])] for i, x in enumerate(lists)}

    def got(frame):
        return {r.id: r.n for r in frame.collect()}

    sent = T.normalize_tokens_by(df, d, "t", "n")
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1       # the repartition above
    assert got(sent) == want
    monkeypatch.setattr(T, "SENT_CHARS", 0)
    joined = T.normalize_tokens_by(df, d, "t", "n")
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert got(joined) == want
    none = d.where("slang = 'absent'")
    assert got(T.normalize_tokens_by(df, none, "t", "n")) == dict(enumerate(lists))
