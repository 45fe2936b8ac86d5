"""Registered evaluation queries (R1-R19, T6) over the prediction views."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanceflow.operators import metrics as M
from stanceflow.operators.index import with_row_index
from stanceflow.operators.ordering import number_rows
from stanceflow.operators.labels import label_profile
from stanceflow.plans.registry import query, rounded
from stanceflow.plans.sqlviews import (
    BASE, LOGITS_VIEW, STANCE_VIEW, class_counts, f1, f1c, ratio, with_views,
)
from stanceflow.plans.views import (
    logits_view, prediction_column, prediction_view, seed_epoch_grid, stance_view, table,
)

RUN = ["seed", "epoch"]

# The positional per-target slices of the SemEval2016 test file.
SEMEVAL_RANGES = (("atheism", 0, 220), ("feminist", 220, 505), ("hillary", 505, 800), ("abortion", 800, 1080))


@query("confusion", BASE + """
SELECT seed, epoch, y, p, count(*) AS n FROM prediction_view GROUP BY seed, epoch, y, p""")
def q_confusion(spark, sf):
    return M.confusion(prediction_view(spark, sf), RUN)


_CLASS_PRF_SQL = BASE + f""", c AS (SELECT seed, epoch, {class_counts()} FROM prediction_view GROUP BY seed, epoch),
cls AS (
  SELECT seed, epoch, n_rows, 0 AS cls, tp_0 AS tp, np_0 AS n_pred, ns_0 AS n_true FROM c
  UNION ALL SELECT seed, epoch, n_rows, 1, tp_1, np_1, ns_1 FROM c
  UNION ALL SELECT seed, epoch, n_rows, 2, tp_2, np_2, ns_2 FROM c)
SELECT seed, epoch, cls, tp, n_pred, n_true,
       round({ratio('tp', 'n_pred')}, 6) AS precision, round({ratio('tp', 'n_true')}, 6) AS recall,
       round({f1('tp', 'n_pred', 'n_true')}, 6) AS f1
FROM cls"""


@query("class_prf", _CLASS_PRF_SQL)
def q_class_prf(spark, sf):
    return rounded(M.class_prf(prediction_view(spark, sf), RUN))


@query("f1_avg2", BASE + f"""
SELECT seed, epoch, round(({f1c(0)} + {f1c(2)}) / 2, 6) AS f1_avg2
FROM (SELECT seed, epoch, {class_counts()} FROM prediction_view GROUP BY seed, epoch)""")
def q_f1_avg2(spark, sf):
    return rounded(M.f1_avg2(prediction_view(spark, sf), RUN))


@query("f1_avg3", BASE + f"""
SELECT seed, epoch, round(({f1c(0)} + {f1c(1)} + {f1c(2)}) / 3, 6) AS f1_avg3
FROM (SELECT seed, epoch, {class_counts()} FROM prediction_view GROUP BY seed, epoch)""")
def q_f1_avg3(spark, sf):
    return rounded(M.f1_avg3(prediction_view(spark, sf), RUN))


@query("f1_micro_all", BASE + f"""
SELECT seed, epoch, round({ratio('n_correct', 'n_rows')}, 6) AS micro_precision,
       round({ratio('n_correct', 'n_rows')}, 6) AS micro_recall, round({ratio('n_correct', 'n_rows')}, 6) AS micro_f1
FROM (SELECT seed, epoch, {class_counts(classes=())} FROM prediction_view GROUP BY seed, epoch)""")
def q_f1_micro_all(spark, sf):
    return rounded(M.f1_micro(prediction_view(spark, sf), RUN))


@query("f1_micro_labels", BASE + f"""
SELECT seed, epoch, round({ratio('tp', 'np')}, 6) AS micro_precision, round({ratio('tp', 'ns')}, 6) AS micro_recall,
       round({f1('tp', 'np', 'ns')}, 6) AS micro_f1
FROM (SELECT seed, epoch, count(*) FILTER (WHERE y = p AND p IN (0, 1, 2)) AS tp,
             count(*) FILTER (WHERE p IN (0, 1, 2)) AS np, count(*) FILTER (WHERE y IN (0, 1, 2)) AS ns
      FROM prediction_view GROUP BY seed, epoch)""")
def q_f1_micro_labels(spark, sf):
    return rounded(M.f1_micro(prediction_view(spark, sf), RUN, labels=[0, 1, 2]))


def _macro_sql(present: bool) -> str:
    classes = (-1, 0, 1, 2) if present else (0, 1, 2)
    counts = class_counts(classes=classes)

    def k(c):
        return f"m{-c}" if c < 0 else str(c)

    if present:
        pres = [f"(CASE WHEN np_{k(c)} + ns_{k(c)} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for c in classes]
        npres = " + ".join(pres)

        def mean(vals):
            tot = " + ".join(f"({v}) * {pr}" for v, pr in zip(vals, pres))
            return f"CASE WHEN ({npres}) > 0 THEN ({tot}) / ({npres}) ELSE 0.0::DOUBLE END"
    else:
        def mean(vals):
            return "(" + " + ".join(f"({v})" for v in vals) + f") / {len(classes)}.0"
    prec = [ratio(f"tp_{k(c)}", f"np_{k(c)}") for c in classes]
    rec = [ratio(f"tp_{k(c)}", f"ns_{k(c)}") for c in classes]
    f1s = [f1c(c) for c in classes]
    return BASE + f"""
SELECT seed, epoch, round({mean(prec)}, 6) AS macro_precision, round({mean(rec)}, 6) AS macro_recall,
       round({mean(f1s)}, 6) AS macro_f1
FROM (SELECT seed, epoch, {counts} FROM prediction_view GROUP BY seed, epoch)"""


@query("f1_macro_present", _macro_sql(True))
def q_f1_macro_present(spark, sf):
    return rounded(M.f1_macro(prediction_view(spark, sf), RUN))


@query("f1_macro_labels", _macro_sql(False))
def q_f1_macro_labels(spark, sf):
    return rounded(M.f1_macro(prediction_view(spark, sf), RUN, labels=[0, 1, 2]))


@query("accuracy", BASE + """
SELECT seed, epoch, round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy,
       count(*) AS n_rows
FROM prediction_view GROUP BY seed, epoch""")
def q_accuracy(spark, sf):
    return rounded(M.accuracy(prediction_view(spark, sf), RUN))


@query("argmax", with_views(LOGITS_VIEW) + """
SELECT vec_id, y, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS p_argmax,
       CAST(CASE WHEN vec_id % 11 = 0 THEN -1 ELSE list_position(logits, list_max(logits)) - 1 END AS INTEGER) AS p,
       round(1.0::DOUBLE / list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))), 6) AS p_top
FROM logits_view""")
def q_argmax(spark, sf):
    lv = M.predict_label(logits_view(spark, sf), "logits", out="p_argmax", prob_out="probs")
    p = F.when(F.pmod(F.col("vec_id"), F.lit(11)) == 0, F.lit(-1)).otherwise(F.col("p_argmax")).cast("int")
    top = F.element_at(F.col("probs"), F.col("p_argmax") + 1)
    return rounded(lv.select("vec_id", "y", "p_argmax", p.alias("p"), top.alias("p_top")))


@query("logits_f1", with_views(LOGITS_VIEW) + f"""
, lp AS (SELECT y, CAST(CASE WHEN vec_id % 11 = 0 THEN -1 ELSE list_position(logits, list_max(logits)) - 1 END
                  AS INTEGER) AS p FROM logits_view)
SELECT round(({f1c(0)} + {f1c(2)}) / 2, 6) AS f1_avg2, round(({f1c(0)} + {f1c(1)} + {f1c(2)}) / 3, 6) AS f1_avg3,
       n_rows
FROM (SELECT {class_counts()} FROM lp)""")
def q_logits_f1(spark, sf):
    lv = M.predict_label(logits_view(spark, sf), "logits", out="p0")
    lv = lv.withColumn("p", F.when(F.pmod(F.col("vec_id"), F.lit(11)) == 0, F.lit(-1))
                       .otherwise(F.col("p0")).cast("int"))
    w = M._wide_counts(lv, [], "y", "p", M.CLASSES)
    return rounded(w.select(((M._f1c(0) + M._f1c(2)) / 2).alias("f1_avg2"),
                            ((M._f1c(0) + M._f1c(1) + M._f1c(2)) / 3).alias("f1_avg3"), "n_rows"))


@query("f1_per_target", BASE + f"""
SELECT seed, epoch, target, n_rows, round(({f1c(0)} + {f1c(2)}) / 2, 6) AS f1
FROM (SELECT seed, epoch, target, {class_counts()} FROM prediction_view GROUP BY seed, epoch, target)""")
def q_f1_per_target(spark, sf):
    return rounded(M.f1_per_target(prediction_view(spark, sf), "target", RUN))


def _ranges_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS range_name, {lo} AS lo, {hi} AS hi" for n, lo, hi in SEMEVAL_RANGES)
    return BASE + f""", idx AS (
  SELECT *, row_number() OVER (PARTITION BY seed, epoch ORDER BY doc_id) - 1 AS idx FROM prediction_view),
ranges AS ({rows}),
runs AS (SELECT DISTINCT seed, epoch FROM prediction_view),
c AS (SELECT r.seed, r.epoch, g.range_name, {class_counts('i.y', 'i.p').replace('count(*)', 'count(i.idx)')}
      FROM runs r CROSS JOIN ranges g
      LEFT JOIN idx i ON i.seed = r.seed AND i.epoch = r.epoch AND i.idx >= g.lo AND i.idx < g.hi
      GROUP BY r.seed, r.epoch, g.range_name)
SELECT seed, epoch, range_name, n_rows, round(({f1c(0)} + {f1c(2)}) / 2, 6) AS f1 FROM c"""


@query("f1_by_ranges", _ranges_sql())
def q_f1_by_ranges(spark, sf):
    sv = with_row_index(stance_view(spark, sf).select("doc_id", "y"), "doc_id", out="idx")
    # the slices end at a fixed position: later rows need no predictions
    sv = sv.where(F.col("idx") < max(hi for _, _, hi in SEMEVAL_RANGES))
    pv = sv.select("doc_id", "idx", "y", seed_epoch_grid()).withColumn("p", prediction_column())
    return rounded(M.f1_by_ranges(pv, SEMEVAL_RANGES, "idx", RUN))


@query("f1_by_ranges_all", BASE + f""", n AS (SELECT target, count(*) AS n FROM stance_view GROUP BY target),
ranges AS (SELECT target AS range_name, sum(n) OVER (ORDER BY target) - n AS lo, sum(n) OVER (ORDER BY target) AS hi FROM n),
idx AS (SELECT *, row_number() OVER (PARTITION BY seed, epoch ORDER BY target, doc_id) - 1 AS idx FROM prediction_view)
SELECT seed, epoch, range_name, n_rows, round(({f1c(0)} + {f1c(2)}) / 2, 6) AS f1
FROM (SELECT i.seed, i.epoch, g.range_name, {class_counts('i.y', 'i.p')}
      FROM idx i JOIN ranges g ON i.idx >= g.lo AND i.idx < g.hi GROUP BY i.seed, i.epoch, g.range_name)""")
def q_f1_by_ranges_all(spark, sf):
    """Ranges from the data: every row of the view in target order is scored."""
    sv = stance_view(spark, sf).select("doc_id", "target", "y")
    sv = M.with_range(number_rows(sv, ["target"], tie_break=["doc_id"]), M.ranges_by_target(sv))
    pv = sv.select("doc_id", "range_name", "y", seed_epoch_grid()).withColumn("p", prediction_column())
    return rounded(M.f1_per_target(pv, "range_name", RUN))


@query("error_rows", BASE + """
SELECT doc_id, seed, epoch, y, p,
       CASE y WHEN 0 THEN 'Against' WHEN 1 THEN 'None' WHEN 2 THEN 'Favor' END AS gold_label,
       CASE p WHEN 0 THEN 'Against' WHEN 1 THEN 'None' WHEN 2 THEN 'Favor' END AS pred_label
FROM prediction_view WHERE y IS DISTINCT FROM p""")
def q_error_rows(spark, sf):
    pv = prediction_view(spark, sf).select("doc_id", "seed", "epoch", "y", "p")
    return M.error_rows(pv, domain="stance")


_PER_TARGET_SEED = f"""pts AS (
  SELECT target, seed, round(({f1c(0)} + {f1c(2)}) / 2, 12) AS f1
  FROM (SELECT target, seed, {class_counts()} FROM prediction_view GROUP BY target, seed))"""


@query("target_seed_matrix", BASE + ", " + _PER_TARGET_SEED + """
SELECT target, seed, round(f1, 6) AS f1, 0 AS is_mean FROM pts
UNION ALL SELECT target, NULL, round(avg(f1), 6), 1 FROM pts GROUP BY target""")
def q_target_seed_matrix(spark, sf):
    res = M.target_seed_matrix(prediction_view(spark, sf))
    return rounded(res.withColumn("is_mean", F.col("is_mean").cast("int")))


_PER_EPOCH_SEED = f"""pes AS (
  SELECT epoch, seed, ({f1c(0)} + {f1c(2)}) / 2 AS value
  FROM (SELECT epoch, seed, {class_counts()} FROM prediction_view GROUP BY epoch, seed))"""


@query("seed_summary", BASE + ", " + _PER_EPOCH_SEED + """
SELECT epoch, seed, round(value, 6) AS value, 0 AS is_mean FROM pes
UNION ALL SELECT epoch, NULL, round(avg(value), 6), 1 FROM pes GROUP BY epoch""")
def q_seed_summary(spark, sf):
    per = M.f1_avg2(prediction_view(spark, sf), ["epoch", "seed"], out="value")
    res = M.seed_summary(per, ["epoch"], "seed", "value")
    return rounded(res.withColumn("is_mean", F.col("is_mean").cast("int")))


_PER_RUN = f"""per AS (
  SELECT target, epoch, seed, ({f1c(0)} + {f1c(2)}) / 2 AS value
  FROM (SELECT target, epoch, seed, {class_counts()} FROM prediction_view GROUP BY target, epoch, seed))"""


def _letter_sql(n: str, letters: int = 4) -> str:
    """Column name by ranges: the k-th letter from the right is there from the
    first ordinal with k + 1 letters on, and then runs through A-Z in steps of
    26^k."""
    out, first = "''", 0
    for k in range(letters):
        first += 26 ** k
        out = (f"CASE WHEN {n} >= {first} THEN chr(CAST(65 + (({n} - {first}) // {26 ** k}) % 26 AS INTEGER)) "
               f"ELSE '' END || {out}")
    return f"({out})"


@query("results_wide", BASE + ", " + _PER_RUN + f""",
w AS (SELECT target, epoch,
             max(value) FILTER (WHERE seed = 1) AS seed_1, max(value) FILTER (WHERE seed = 2) AS seed_2,
             max(value) FILTER (WHERE seed = 3) AS seed_3
      FROM per GROUP BY target, epoch),
o AS (SELECT *, dense_rank() OVER (ORDER BY target, epoch) + 691 AS ordinal FROM w)
SELECT target, epoch, round(seed_1, 6) AS seed_1, round(seed_2, 6) AS seed_2, round(seed_3, 6) AS seed_3,
       round(list_avg([seed_1, seed_2, seed_3]), 6) AS mean, {_letter_sql('ordinal')} AS "column"
FROM o""")
def q_results_wide(spark, sf):
    per = M.f1_avg2(prediction_view(spark, sf), ["target", "epoch", "seed"], out="value")
    return rounded(M.results_wide(per, ["target", "epoch"], first_column=692))


_POLICY_SQL = BASE + f""", c AS (SELECT seed, epoch, {class_counts(classes=(0, 1, 2))} FROM prediction_view
                  GROUP BY seed, epoch),
t AS (SELECT seed, epoch, target, {class_counts()} FROM prediction_view GROUP BY seed, epoch, target),
present AS ({_macro_sql(True).removeprefix(BASE)})
SELECT 'SemEval2016' AS policy, seed, epoch, 'overall' AS scope, 'avg2' AS name,
       round(({f1c(0)} + {f1c(2)}) / 2, 6) AS value FROM c
UNION ALL SELECT 'SemEval2016', seed, epoch, 'target', target, round(({f1c(0)} + {f1c(2)}) / 2, 6) FROM t
UNION ALL SELECT 'Covid19', seed, epoch, 'overall', 'avg3', round(({f1c(0)} + {f1c(1)} + {f1c(2)}) / 3, 6) FROM c
UNION ALL SELECT 'Covid19', seed, epoch, 'target', target, round(({f1c(0)} + {f1c(1)} + {f1c(2)}) / 3, 6) FROM t
UNION ALL SELECT 'vast', seed, epoch, 'overall', 'macro', round(({f1c(0)} + {f1c(1)} + {f1c(2)}) / 3, 6) FROM c
UNION ALL SELECT 'vast', seed, epoch, 'class', 'Against', round({f1c(0)}, 6) FROM c
UNION ALL SELECT 'vast', seed, epoch, 'class', 'None', round({f1c(1)}, 6) FROM c
UNION ALL SELECT 'vast', seed, epoch, 'class', 'Favor', round({f1c(2)}, 6) FROM c
UNION ALL SELECT 'vast_present', seed, epoch, 'overall', 'macro', macro_f1 FROM present
UNION ALL SELECT 'vast_micro', seed, epoch, 'overall', 'micro', round({ratio('n_correct', 'n_rows')}, 6) FROM c"""


@query("evaluate_policy", _POLICY_SQL)
def q_evaluate_policy(spark, sf):
    pv = prediction_view(spark, sf)
    # one aggregation of the data; every policy reads the counter table
    counts = M.target_counts(pv, RUN)
    parts = [
        ("SemEval2016", M.evaluate(pv, "SemEval2016", per_target=True, by=RUN, counts=counts)),
        ("Covid19", M.evaluate(pv, "Covid19", per_target=True, by=RUN, counts=counts)),
        ("vast", M.evaluate(pv, "vast", aux_eval=True, metric="macro", per_target=True, by=RUN,
                            fixed_labels=True, counts=counts)),
        ("vast_present", M.evaluate(pv, "vast", aux_eval=True, metric="macro", by=RUN, counts=counts)),
        ("vast_micro", M.evaluate(pv, "vast", aux_eval=True, metric="micro", by=RUN, counts=counts)),
    ]
    out = None
    for name, df in parts:
        d = df.select(F.lit(name).alias("policy"), *RUN, "scope", "name", "value")
        out = d if out is None else out.unionByName(d)
    return rounded(out)


_PER_TARGET_EPOCH = f"""tse AS (
  SELECT target, seed, epoch, ({f1c(0)} + {f1c(2)}) / 2 AS f1, n_rows, n_correct
  FROM (SELECT target, seed, epoch, {class_counts()} FROM prediction_view GROUP BY target, seed, epoch))"""


@query("best_checkpoint", BASE + ", " + _PER_TARGET_EPOCH + """
SELECT target, seed, epoch, round(f1, 6) AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY target, seed ORDER BY f1 DESC, epoch) AS rk FROM tse WHERE f1 > 0)
WHERE rk = 1""")
def q_best_checkpoint(spark, sf):
    per = M.f1_per_target(prediction_view(spark, sf), "target", ["seed", "epoch"])
    return rounded(M.best_checkpoint(per.select("target", "seed", "epoch", "f1"), ["target", "seed"]))


@query("early_stop", BASE + ", " + _PER_TARGET_EPOCH + """,
l AS (SELECT target, seed, epoch, 1.0 - n_correct::DOUBLE / n_rows AS eval_loss FROM tse),
m AS (SELECT *, CASE WHEN min(eval_loss) OVER (PARTITION BY target, seed ORDER BY epoch
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL
                       OR eval_loss < min(eval_loss) OVER (PARTITION BY target, seed ORDER BY epoch
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                     THEN 1 ELSE 0 END AS imp FROM l),
g AS (SELECT *, sum(imp) OVER (PARTITION BY target, seed ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS grp FROM m),
s AS (SELECT *, row_number() OVER (PARTITION BY target, seed, grp ORDER BY epoch) - 1 AS streak FROM g),
st AS (SELECT target, seed, coalesce(min(epoch) FILTER (WHERE streak >= 1), max(epoch)) AS stop_epoch
       FROM s GROUP BY target, seed),
b AS (SELECT s.target, s.seed, st.stop_epoch, s.epoch, s.eval_loss,
             row_number() OVER (PARTITION BY s.target, s.seed ORDER BY s.eval_loss, s.epoch) AS rk
      FROM s JOIN st USING (target, seed) WHERE s.epoch <= st.stop_epoch)
SELECT target, seed, stop_epoch, epoch AS best_epoch, round(eval_loss, 6) AS best_loss FROM b WHERE rk = 1""")
def q_early_stop(spark, sf):
    acc = M.accuracy(prediction_view(spark, sf), ["target", "seed", "epoch"])
    loss = acc.select("target", "seed", "epoch", (F.lit(1.0) - F.col("accuracy")).alias("eval_loss"))
    return rounded(M.early_stop(loss, ["target", "seed"], patience=1))


@query("best_config", BASE + ", " + _PER_TARGET_EPOCH + """,
cfg AS (SELECT target, epoch, avg(f1) AS mean FROM tse GROUP BY target, epoch)
SELECT target, epoch, round(mean, 6) AS mean FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY mean DESC, epoch) AS rk FROM cfg) WHERE rk = 1""")
def q_best_config(spark, sf):
    per = M.f1_per_target(prediction_view(spark, sf), "target", ["seed", "epoch"])
    cfg = per.groupBy("target", "epoch").agg(F.avg("f1").alias("mean"))
    return rounded(M.best_config(cfg, ["target"], ["epoch"], "mean"))


EVALUATORS = ("eval_0", "eval_1", "eval_2", "eval_3", "eval_4")


def _score_sql() -> str:
    cols_mean = ", ".join(f"round(avg(value) FILTER (WHERE evaluator = '{e}'), 6) AS {e}" for e in EVALUATORS[:4])
    cols_std = ", ".join(f"round(stddev_pop(value) FILTER (WHERE evaluator = '{e}'), 6) AS {e}"
                         for e in EVALUATORS[:4])
    return f"""WITH ev AS (SELECT event_type AS explainer, 'eval_' || CAST(user_id % 4 AS VARCHAR) AS evaluator, value
            FROM events)
SELECT 'mean' AS stat, explainer, {cols_mean} FROM ev GROUP BY explainer
UNION ALL SELECT 'std', explainer, {cols_std} FROM ev GROUP BY explainer"""


@query("score_summary", _score_sql())
def q_score_summary(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("explainer"),
        F.concat(F.lit("eval_"), F.pmod(F.col("user_id"), F.lit(4)).cast("string")).alias("evaluator"),
        F.col("value"))
    return rounded(M.score_summary(ev, "explainer", "evaluator", "value", EVALUATORS))


@query("label_profile_rollup", with_views(STANCE_VIEW) + """
SELECT target, stance, count(*) AS n_rows FROM stance_view GROUP BY ROLLUP (target, stance)""")
def q_label_profile(spark, sf):
    return label_profile(stance_view(spark, sf), ["target", "stance"])

