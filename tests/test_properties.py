"""Property tests (hypothesis): metric ranges, micro = accuracy."""

from hypothesis import given, settings
from hypothesis import strategies as st

from stanceflow.operators import metrics as M

labels = st.lists(st.tuples(st.integers(0, 2), st.integers(-1, 2)), min_size=1, max_size=40)


@settings(max_examples=12, deadline=None)
@given(rows=labels)
def test_f1_in_unit_interval_and_micro_is_accuracy(spark, rows):
    df = spark.createDataFrame(rows, "y int, p int")
    prf = M.class_prf(df).collect()
    assert all(0.0 <= r["f1"] <= 1.0 and 0.0 <= r["precision"] <= 1.0 for r in prf)
    micro = M.f1_micro(df).first()["micro_f1"]
    acc = sum(1 for y, p in rows if y == p) / len(rows)
    assert abs(micro - acc) < 1e-12
    for col, df2 in (("macro_f1", M.f1_macro(df)), ("macro_f1", M.f1_macro(df, labels=[0, 1, 2]))):
        assert 0.0 <= df2.first()[col] <= 1.0
