"""Long keyword lists and the jointly trained two-head model."""

import random
import time

import numpy as np
import pytest

from stanceflow.operators import joint as JT
from stanceflow.operators import perturb as T
from stanceflow.operators.keywords import Keywords, explicit_flag_many, runs


def test_keywords_equal_contains():
    r = random.Random(1)
    letters = "abcé中\U0001f600 "
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["", "a", "c" * 5000]
    for size in (1, 5, 300):
        words = ["".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(size)]
        words += [t[3:14] for t in texts[:size // 50] if len(t) > 14]
        got = Keywords(words).found_in(texts).tolist()
        assert got == [any(w in t for w in words) for t in texts]
    assert Keywords([None]).found_in(["x", ""]).tolist() == [False, False]
    assert Keywords(["", "x"]).found_in(["y", ""]).tolist() == [True, True]
    assert Keywords(["ab"]).found_in(["a", "b"]).tolist() == [False, False]  # not across texts


def test_many_keywords_cost_little_more_than_few():
    r = random.Random(2)
    texts = [" ".join(str(r.randint(10**6, 10**7)) for _ in range(300)) for _ in range(400)]
    words = [f"w{r.randint(10**8, 10**9)}" for _ in range(10_000)]
    times = []
    for size in (10, 10_000):
        match, best = Keywords(words[:size]), 1e9
        for _ in range(3):
            at = time.perf_counter()
            assert not match.found_in(texts).any()
            best = min(best, time.perf_counter() - at)
        times.append(best)
    assert times[1] < 2 * times[0] + 0.05


def test_flags_on_frames(spark):
    rows = [(1, "en", "the cat"), (2, "en", "a dog"), (3, "de", "der Hund"), (4, "en", None), (5, "de", ""),
            (6, "none", "the")]
    df = spark.createDataFrame(rows, "k long, target string, text string")
    kw = spark.createDataFrame([("en", ["the", None]), ("de", ["Hund"]), ("en", ["dog"]), ("none", []), ("none", None),
                                (None, ["a"])], "target string, keywords array<string>")
    want = {1: True, 2: True, 3: True, 4: None, 5: False, 6: False}
    assert {r.k: r.explicit for r in explicit_flag_many(df, kw).collect()} == want
    joined = explicit_flag_many(df.where("k < 4"), kw, most=3)      # beyond the bound: the join
    assert {r.k: r.explicit for r in joined.collect()} == {1: True, 2: True, 3: True}
    assert explicit_flag_many(df.limit(0), kw).count() == 0
    with pytest.raises(Exception, match="no keywords for target"):
        explicit_flag_many(df, kw.where("target = 'en'")).collect()
    small = spark.createDataFrame([("en", ["the"]), ("de", ["H"]), ("none", ["x"])], "target string, keywords array<string>")
    flag = {r.k: r.explicit for r in T.explicit_flag(df, small).collect()}
    assert flag == {r.k: r.explicit for r in explicit_flag_many(df, small).collect()}
    assert list(runs(["a" * (1 << 20), "b", None, "c"])) == [(0, 1), (1, 4)] and list(runs([])) == []


def planted(spark):
    """Task 0: a word decides the class; task 1: another one the target."""
    rows = []
    for i in range(90):
        rows.append((2 * i, ["the", ["bad", "meh", "good"][i % 3], "x%d" % (i % 7)], ["topic"], 0, i % 3))
        rows.append((2 * i + 1, ["the", "about%d" % (i % 4), "x%d" % (i % 5)], [], 1, i % 4))
    rows.append((1000, [], [], 0, 1))
    return spark.createDataFrame(rows, "row_id long, tokens array<string>, target_tokens array<string>, task int, label int")


@pytest.fixture(scope="module")
def prepared(spark):
    return JT.prepare(planted(spark), "row_id", width=3)


def dense(rows, n_terms):
    x = np.zeros((len(rows), n_terms))
    for i, r in enumerate(rows):
        x[i, list(r.idx)] = r.weight
    return x, np.array([r.task for r in rows]), np.array([r.label for r in rows])


def plain_fit(x, task, label, start, classes, steps, rate, aux_share):
    """The same training on a dense matrix, written for itself."""
    w, heads = start.copy(), [np.zeros((start.shape[1], c)) for c in classes]
    bias, told = [np.zeros(c) for c in classes], []
    for _ in range(steps):
        move, losses, down = np.zeros_like(w), [], []
        for t, share in ((0, 1.0), (1, aux_share)):
            xt, y = x[task == t], np.eye(classes[t])[label[task == t]]
            z = xt @ w @ heads[t] + bias[t]
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            losses.append(float(-(y * np.log(p)).sum(axis=1).mean()))
            d = share * (p - y) / len(xt)
            move += xt.T @ d @ heads[t].T
            down.append(((xt @ w).T @ d, d.sum(axis=0)))
        w = w - rate * move
        for t, (dh, db) in enumerate(down):
            heads[t], bias[t] = heads[t] - rate * dh, bias[t] - rate * db
        told.append(tuple(losses))
    return w, heads, bias, told


@pytest.mark.parametrize("aux_share", [1.0, 0.25])
def test_joint_fit_equals_a_plain_one(spark, prepared, aux_share):
    rows, index = prepared
    model, told = JT.fit(rows, index, (3, 4), steps=5, rate=2.0, aux_share=aux_share)
    found = index.orderBy("idx").collect()
    assert [r.idx for r in found] == list(range(len(found)))
    start = np.array([r.start for r in found])
    x, task, label = dense(rows.collect(), len(found))
    assert np.allclose(np.linalg.norm(x, axis=1)[x.any(axis=1)], 1.0) and (~x.any(axis=1)).sum() == 1
    w, heads, bias, want = plain_fit(x, task, label, start, (3, 4), 5, 2.0, aux_share)
    assert np.allclose(model.shared, w, atol=1e-10) and np.allclose(told, want, atol=1e-10)
    for t in (0, 1):
        assert np.allclose(model.heads[t][:-1], heads[t], atol=1e-10)
        assert np.allclose(model.heads[t][-1], bias[t], atol=1e-10)
    assert told[0] == pytest.approx((np.log(3), np.log(4)))


def test_auxiliary_loss_moves_the_shared_matrix(spark, prepared):
    rows, index = prepared
    alone, _ = JT.fit(rows, index, (3, 4), steps=4, rate=2.0, aux_share=0.0)
    both, _ = JT.fit(rows, index, (3, 4), steps=4, rate=2.0, aux_share=1.0)
    assert np.abs(both.shared - alone.shared).max() > 1e-3
    assert not alone.heads[1].any() and both.heads[1].any()


def test_both_heads_learn_and_rows_are_routed(spark, prepared, monkeypatch):
    monkeypatch.setattr(JT, "GRADIENT_BLOCK", 16)    # several blocks a gradient
    rows, index = prepared
    model, told = JT.fit(rows, index, (3, 4), steps=40, rate=3.0)
    scored = JT.score(model, rows).collect()
    assert {r.task: len(r.logits) for r in scored} == {0: 3, 1: 4}
    right = [int(np.argmax(r.logits)) == r.label for r in scored if r.row_id != 1000]
    assert np.mean(right) > 0.9 and told[-1][0] < told[0][0] and told[-1][1] < told[0][1]
    with pytest.raises(ValueError, match="diverges"), np.errstate(all="ignore"):
        JT.fit(rows, index, (3, 4), steps=40, rate=1e200)
    with pytest.raises(ValueError, match="too large"):
        monkeypatch.setattr(JT, "MODEL_SIZE", 10)
        JT.fit(rows, index, (3, 4), steps=1)


def test_fewer_terms_keep_the_most_frequent(spark):
    rows, index = JT.prepare(planted(spark), "row_id", terms=2, width=2)
    assert [r.term for r in index.orderBy("idx").collect()] == ["the", "topic"]
    assert rows.count() == 181 and max(len(r.idx) for r in rows.collect()) <= 2


@pytest.mark.parametrize("repeated", [False, True])
def test_terms_are_counted_where_rows_are(spark, repeated):
    """Features as a plain loop gives them, from counts that were written once:
    nothing of the texts is left in the plan. Rows of one key count together."""
    from stanceflow.operators.model import ta_features

    rows = [(1, ["a", "b", "a"], ["a", "t"]), (2, ["b", None], [None, "t", "t"]), (3, [], []), (4, None, ["a"]),
            (None, ["a", "é"], None), (6, ["c"], [])]
    if repeated:
        rows += [(1, ["a", "c"], ["u"]), (None, ["é"], ["a"]), (6, None, None)]
    df = spark.createDataFrame(rows, "k long, tokens array<string>, target_tokens array<string>").repartition(3)
    found = ta_features(df, 0.5, "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    tf, aimed = {}, {}
    for k, text, target in rows:
        for t in text or []:
            tf[k, t] = tf.get((k, t), 0) + 1
        for t in target or []:
            aimed[k, t] = aimed.get((k, t), 0) + 1
    idf = {t: np.log((len(rows) + 1) / (sum(u == t for _, u in tf) + 1)) for _, t in tf}
    want = {(k, t): (tf.get((k, t), 0) * idf[t] if t is not None and (k, t) in tf else 0.0) + 1.5 * aimed.get((k, t), 0)
            for k, t in {*tf, *aimed} if t is not None or (k, t) in aimed}
    got = found.collect()
    assert len(got) == len(want) and {(r.k, r.term): r.weight for r in got} == pytest.approx(want)
