"""Pair encoding, span edges and head masks."""

from hypothesis import given, settings
from hypothesis import strategies as st

from stanceflow.operators import pairs as E


def _span(spark, n_text, n_target, max_len=128):
    df = spark.createDataFrame([(["w"] * n_text, ["t"] * n_target)], "tokens array<string>, target_tokens array<string>")
    r = E.target_span(E.encode_pair(df, max_len=max_len)).first()
    return r["seq"], r["span_start"], r["span_end"]


def test_exactly_full_text_is_extra_long(spark):
    seq, b, e = _span(spark, 126, 3)
    assert len(seq) == 128 and e is None


def test_one_token_fewer_gives_empty_span(spark):
    seq, b, e = _span(spark, 125, 3)
    assert (b, e) == (127, 127)


def test_target_cut_keeps_prefix(spark):
    seq, b, e = _span(spark, 120, 10)
    assert (b, e) == (122, 127)
    assert seq[-1] == "[SEP]"


def test_empty_target_and_text(spark):
    assert _span(spark, 5, 0)[1:] == (7, 7)
    assert _span(spark, 0, 3)[1:] == (2, 5)


def test_pad_and_mask(spark):
    df = spark.createDataFrame([(["a", "b"], ["t"])], "tokens array<string>, target_tokens array<string>")
    r = E.pad_truncate(E.encode_pair(df, max_len=8), max_len=8).first()
    assert r["input_tokens"] == ["[CLS]", "a", "b", "[SEP]", "t", "[SEP]", "<pad>", "<pad>"]
    assert r["attention_mask"] == [1, 1, 1, 1, 1, 1, 0, 0]


@settings(max_examples=15, deadline=None)
@given(n_text=st.integers(0, 20), n_target=st.integers(0, 6), max_len=st.integers(4, 24))
def test_span_inside_sequence(spark, n_text, n_target, max_len):
    seq, b, e = _span(spark, n_text, n_target, max_len)
    assert len(seq) <= max_len and seq[0] == "[CLS]" and seq[-1] == "[SEP]"
    if e is not None:
        assert 0 < b <= e < len(seq)
        assert all(t == "t" for t in seq[b:e])


def test_head_mask_follows_label(spark):
    rows = E.head_mask(spark, "1.00l_0.50h").collect()
    on = {(r["layer"], r["head"]) for r in rows if r["on"]}
    assert len(rows) == 144 and on == {(l, h) for l in range(12) for h in range(6)}
    assert sum(r["on"] for r in E.head_mask(spark, "0.50l_0.25h").collect()) == 18
    assert sum(r["on"] for r in E.head_mask(spark, None).collect()) == 144


def test_ta_bias_cells(spark):
    df = spark.createDataFrame([(1, 3, 6), (2, 4, None), (3, 5, 5)], "doc_id long, span_start int, span_end int")
    cells = E.ta_bias_cells(E.ta_bias(df, 0.4)).collect()
    assert sorted((r["j"], r["k"]) for r in cells) == [(j, k) for j in range(3, 6) for k in range(3, 6)]
    assert all(r["bias"] == 0.4 for r in cells)


def test_update_by_ids_first_wins(spark):
    base = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id long, alpha double")
    upd = spark.createDataFrame([(1, 0.9, 0), (1, 0.1, 1), (7, 0.3, 0)], "id long, alpha double, update_seq int")
    got = {r["id"]: (r["alpha"], r["updated"]) for r in E.update_by_ids(base, upd, "id", "alpha").collect()}
    assert got == {1: (0.9, True), 2: (0.5, False)}


def test_span_needs_matching_model(spark):
    df = spark.createDataFrame([(["a"], ["t"])], "tokens array<string>, target_tokens array<string>")
    enc = E.encode_pair(df, model="Bertweet", max_len=16)
    ok = E.target_span(enc, model="Bertweet").first()
    wrong = E.target_span(enc, model="Bert").first()
    assert (ok["span_start"], ok["span_end"]) == (3, 4)
    assert wrong["span_start"] is None and wrong["span_end"] is None


def test_head_mask_multiplies_each_row(spark):
    df = spark.createDataFrame([(1, 3, 6), (2, 4, None)], "doc_id long, span_start int, span_end int")
    rows = E.head_mask_bias(E.ta_bias(df, 0.5), ["0.50l_0.25h"]).collect()
    assert len(rows) == 288
    assert sum(r["bias_mass"] for r in rows if r["doc_id"] == 1) == 18 * 0.5 * 9
    assert all(r["bias_mass"] == 0 for r in rows if r["doc_id"] == 2 or not r["on"])


def test_head_mask_mass_sums_the_cells(spark):
    df = E.ta_bias(spark.createDataFrame([(1, 3, 6), (2, 4, None)], "doc_id long, span_start int, span_end int"), 0.5)
    specs = ["0.50l_0.25h", "1.00l_1.00h", "0.00l_1.00h", "0.30l_0.10h"]
    cells = {}
    for r in E.head_mask_bias(df, specs).collect():
        on, mass = cells.get((r["doc_id"], r["mask"]), (0, 0.0))
        cells[r["doc_id"], r["mask"]] = (on + r["on"], mass + r["bias_mass"])
    got = {(r["doc_id"], r["mask"]): (r["layers_on"] * r["heads_on"], r["total_mass"])
           for r in E.head_mask_mass(df, specs).collect()}
    assert got == cells and len(got) == 8
