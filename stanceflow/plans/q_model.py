"""Registered modelling queries (M1-M5). A fit has no SQL form, but much about
it is determined: fold sizes, routed rows, that each row gets a class of the
domain, and that a fitted model beats the class shares on its training rows.
Those are what the keys return."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stanceflow.functions.text import clean_stance_tokens
from stanceflow.operators import joint as JT
from stanceflow.operators import metrics as M
from stanceflow.operators import model as MD
from stanceflow.operators.labels import aux_frame
from stanceflow.plans.registry import query, rounded
from stanceflow.plans.sqlviews import STANCE_VIEW, lit, sql_clean_stance, with_views
from stanceflow.plans.views import SEEDS, stance_view, table
from stanceflow.sources.readers import split_by_key

SV = with_views(STANCE_VIEW)
#: Ids of the stance view's targets (a fixed list, as in the label file).
TARGET_IDS = {"de": 0, "en": 1, "es": 2, "fr": 3}


def model_frame(spark, sf):
    sv = split_by_key(stance_view(spark, sf), "doc_id")
    return sv.select("doc_id", "target", "y", "split", clean_stance_tokens("text").alias("tokens"),
                     clean_stance_tokens("target_text").alias("target_tokens"))


@query("ta_features", SV + f""",
t AS (SELECT doc_id, unnest({sql_clean_stance('text')}) AS term FROM stance_view),
g AS (SELECT doc_id, unnest({sql_clean_stance('target_text')}) AS term FROM stance_view),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM stance_view),
w AS (SELECT doc_id, term, tf * ln((n + 1)::DOUBLE / (df + 1)) AS weight FROM tf JOIN df USING (term), n
      UNION ALL SELECT doc_id, term, count(*) * 1.5::DOUBLE FROM g GROUP BY doc_id, term)
SELECT doc_id, term, round(sum(weight), 6) AS weight FROM w GROUP BY doc_id, term""")
def q_ta_features(spark, sf):
    return rounded(MD.ta_features(model_frame(spark, sf), alpha=0.5))


_FOLD = "('0x' || substr(md5(s.seed || ':' || doc_id), 1, 8))::BIGINT % 5 = 0"


@query("train_classifier", SV + f"""
SELECT CAST(s.seed AS INTEGER) AS seed, count(*) FILTER (WHERE doc_id % 10 <> 9 AND NOT {_FOLD}) AS n_train,
       count(*) FILTER (WHERE doc_id % 10 <> 9 AND {_FOLD}) AS n_val, true AS beats_class_shares
FROM stance_view, range(1, 4) s(seed) GROUP BY s.seed""")
def q_train_classifier(spark, sf):
    """One model per seed (the seed picks the validation fold): fold sizes, and
    whether the loss on the training fold is below that of the class shares."""
    data = model_frame(spark, sf).filter(F.col("split") != "test")
    out = None
    for seed in SEEDS:
        folds = MD.seed_split(data, seed)
        model = MD.train_classifier(folds.filter(F.col("fold") == "train"), max_iter=10)
        scored = MD.score_classifier(model, folds).withColumn("loss", MD.log_loss())
        train = F.col("fold") == "train"
        counts = [F.count_if(train & (F.col("y") == c)).cast("double") for c in M.CLASSES]
        n = sum(counts[1:], counts[0])
        shares = sum((F.when(c > 0, -c * F.log(c / n)).otherwise(0.0) for c in counts), F.lit(0.0))
        row = scored.agg(F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_val"),
                         (F.sum(F.when(train, F.col("loss"))) < shares).alias("beats_class_shares"))
        row = row.select(F.lit(seed).alias("seed"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("score_classifier", SV + """
SELECT target, count(*) AS n_rows, count(*) AS n_in_domain, count(*) AS n_argmax
FROM stance_view WHERE doc_id % 10 = 9 GROUP BY target""")
def q_score_classifier(spark, sf):
    """Train on train + val, score the test split; per target, the rows with a
    class of the domain and those whose class is the largest logit's."""
    data = model_frame(spark, sf)
    model = MD.train_classifier(data.filter(F.col("split") != "test"), max_iter=10)
    scored = MD.score_classifier(model, data.filter(F.col("split") == "test"))
    scored = M.predict_label(scored, "logits", out="p_argmax")
    return scored.groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.count_if(F.col("p").isin(*M.CLASSES)).alias("n_in_domain"),
                                        F.count_if(F.col("p") == F.col("p_argmax")).alias("n_argmax"))


_IDS = " ".join(f"WHEN {lit(t)} THEN {i}" for t, i in TARGET_IDS.items())


@query("two_head", SV + f""",
r AS (SELECT CASE target {_IDS} END AS target_id, t.task FROM stance_view, range(2) t(task) WHERE doc_id % 10 = 9)
SELECT CAST(task AS INTEGER) AS task, target_id, count(*) AS n_rows, count(*) AS n_in_domain FROM r
GROUP BY task, target_id""")
def q_two_head(spark, sf):
    """Task 0: stance head; task 1: target-id head trained on rows without
    class 1. Per task and target id, the test rows routed and those that got a
    class of their head's domain."""
    ids = F.create_map(*[F.lit(x) for kv in TARGET_IDS.items() for x in kv])
    data = model_frame(spark, sf).withColumn("target_id", ids[F.col("target")])
    train = data.filter(F.col("split") != "test")
    # the auxiliary task predicts the target id from the text alone
    aux = aux_frame(train, "tokens", "target_id", "y").withColumn(
        "target_tokens", F.array().cast("array<string>"))
    main_model, aux_model = MD.two_head(train, aux, max_iter=10)
    test = data.filter(F.col("split") == "test")
    routed = test.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("task"))
    scored = MD.route(main_model, aux_model, routed)
    last = F.when(F.col("task") == 0, max(M.CLASSES)).otherwise(max(TARGET_IDS.values()))
    return scored.groupBy("task", "target_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                                   F.count_if(F.col("p").between(0, last)).alias("n_in_domain"))


def _weight(c: int, i: int) -> int:
    """Literal weights of a linear model with three classes."""
    return (3 * i + 5 * c + i * c) % 11 - 5


@query("batch_score", f"""
WITH s AS (SELECT vec_id, [{', '.join(
    f"list_sum(list_transform(range(64), lambda i: CAST(embedding[i + 1] AS DOUBLE) * ((3 * i + {5 * c} + i * {c}) % 11 - 5)))"
    for c in range(3))}] AS logits FROM embeddings)
SELECT vec_id, round(logits[1], 6) AS logit_0, round(logits[2], 6) AS logit_1, round(logits[3], 6) AS logit_2,
       CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS p FROM s""")
def q_batch_score(spark, sf):
    """M4: a caller's linear model over all 64 dimensions, in Arrow batches."""
    weights = np.array([[_weight(c, i) for c in range(3)] for i in range(64)], dtype=float)

    def model(pdf):
        return np.array(pdf["embedding"].tolist(), dtype=float) @ weights

    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = M.predict_label(MD.score_batches(emb, model, ["embedding"], batch_size=1024), "logits")
    return rounded(scored.select("vec_id", *[F.get("logits", F.lit(c)).alias(f"logit_{c}") for c in range(3)], "p"))


JOINT_WIDTH = 4
JOINT_RATE = 2.0


def joint_frame(spark, sf):
    """Task 0: text and target to the stance; task 1: the text alone to the
    target's id, without rows of class 1."""
    ids = F.create_map(*[F.lit(x) for kv in TARGET_IDS.items() for x in kv])
    data = model_frame(spark, sf).withColumn("target_id", ids[F.col("target")])
    both = data.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("task"))
    return both.where((F.col("task") == 0) | (F.col("y") != 1)).select(
        (F.col("doc_id") * 2 + F.col("task")).alias("row_id"), "tokens",
        F.when(F.col("task") == 0, F.col("target_tokens")).otherwise(F.array().cast("array<string>")).alias("target_tokens"),
        "task", F.when(F.col("task") == 0, F.col("y")).otherwise(F.col("target_id")).alias("label"))


def _joint_sql() -> str:
    start = ", ".join(f"-0.25 + ('0x' || substr(md5('1:' || term || ':{j}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 0.5"
                      f" AS e{j}" for j in range(JOINT_WIDTH))
    hidden = ", ".join(f"coalesce(sum(u.w * t.e{j}), 0) AS h{j}" for j in range(JOINT_WIDTH))
    # heads start at zero: every class has the same probability in the first step
    slopes = ", ".join(f"{JOINT_RATE!r} * sum(h{j} * ((label = c)::INTEGER - 1.0::DOUBLE / k)) / count(*) AS a{j}"
                       for j in range(JOINT_WIDTH))
    logit = " + ".join(f"h.h{j} * g.a{j}" for j in range(JOINT_WIDTH))
    return SV + f""",
r0 AS (SELECT doc_id * 2 + task AS row_id, CAST(task AS INTEGER) AS task, text, target_text,
              CASE WHEN task = 0 THEN y ELSE CASE target {_IDS} END END AS label, CASE WHEN task = 0 THEN 3 ELSE 4 END AS k
       FROM stance_view, range(2) t(task) WHERE task = 0 OR y <> 1),
x AS (SELECT row_id, unnest({sql_clean_stance('text')}) AS term FROM r0),
gx AS (SELECT row_id, unnest({sql_clean_stance('target_text')}) AS term FROM r0 WHERE task = 0),
tf AS (SELECT row_id, term, count(*) AS tf FROM x GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM r0),
w AS (SELECT row_id, term, sum(weight) AS weight FROM (
        SELECT row_id, term, tf * ln((n + 1)::DOUBLE / (df + 1)) AS weight FROM tf JOIN df USING (term), n
        UNION ALL SELECT row_id, term, count(*) * 1.5::DOUBLE FROM gx GROUP BY row_id, term) GROUP BY ALL),
u AS (SELECT row_id, term, weight / coalesce(nullif(sqrt(sum(weight * weight) OVER (PARTITION BY row_id)), 0), 1) AS w FROM w),
t AS (SELECT DISTINCT term, {start} FROM w),
h AS (SELECT r0.row_id, r0.task, r0.label, r0.k, {hidden}
      FROM r0 LEFT JOIN u ON u.row_id = r0.row_id LEFT JOIN t ON t.term = u.term GROUP BY ALL),
cl AS (SELECT h.*, c FROM h, range(4) c(c) WHERE c < k),
g AS (SELECT task, c, {slopes},
             {JOINT_RATE!r} * sum((label = c)::INTEGER - 1.0::DOUBLE / k) / count(*) AS b FROM cl GROUP BY task, c, k),
z AS (SELECT h.row_id, h.task, h.label, h.k, g.c, {logit} + g.b AS z FROM h JOIN g ON g.task = h.task),
l AS (SELECT row_id, task, any_value(k) AS k, ln(sum(exp(z))) - max(z) FILTER (WHERE c = label) AS loss
      FROM z GROUP BY row_id, task)
SELECT task, count(*) AS n_rows, round(ln(any_value(k)::DOUBLE), 6) AS loss_0, round(avg(loss), 6) AS loss_1, true AS falls
FROM l GROUP BY task"""


@query("joint_two_head", _joint_sql())
def q_joint_two_head(spark, sf):
    """M5: both heads on one shared matrix. Per task: rows, the mean loss before
    and after the first step (both follow from the features, the matrix's first
    values and the gradient), and whether the last loss is below the first."""
    rows, index = JT.prepare(joint_frame(spark, sf), "row_id", terms=1 << 20, width=JOINT_WIDTH)
    _, told = JT.fit(rows, index, (3, len(TARGET_IDS)), steps=6, rate=JOINT_RATE)
    first, second = (F.when(F.col("task") == 0, F.lit(told[i][0])).otherwise(F.lit(told[i][1])) for i in (0, 1))
    falls = F.when(F.col("task") == 0, F.lit(told[-1][0] < told[0][0])).otherwise(F.lit(told[-1][1] < told[0][1]))
    return rounded(rows.groupBy("task").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "task", "n_rows", first.alias("loss_0"), second.alias("loss_1"), falls.alias("falls")))
