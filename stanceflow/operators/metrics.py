"""Evaluation aggregates.

Every metric is one partial + final hash aggregation of conditional counts
per group: the per-class table is built from the *aggregated* counts (at most
groups x classes rows), never by crossing the data with a class table. A hot
group (a target holding a third of the rows) only feeds more rows into the
map-side partial aggregate, which is harmless.

For class c: tp (y = c and p = c), n_pred (p = c), n_true (y = c).
P = tp / n_pred, R = tp / n_true, F1 = 2 tp / (n_pred + n_true), 0 on a zero
denominator. A prediction of -1 (unknown) is a miss for its true class and is
never a predicted class unless a metric says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stanceflow.functions.labels import decode_label

CLASSES = (0, 1, 2)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def f1_expr(tp: Column, n_pred: Column, n_true: Column) -> Column:
    return _ratio(F.lit(2.0) * tp, n_pred + n_true)


def _wide_counts(df: DataFrame, by: Sequence[str], y: str, p: str, classes: Sequence[int]) -> DataFrame:
    yc, pc = F.col(y), F.col(p)
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(yc == pc).alias("n_correct")]
    for c in classes:
        k = _suffix(c)
        aggs += [
            F.count_if((yc == c) & (pc == c)).alias(f"tp_{k}"),
            F.count_if(pc == c).alias(f"np_{k}"),
            F.count_if(yc == c).alias(f"ns_{k}"),
        ]
    return df.groupBy(*by).agg(*aggs)


def _suffix(c: int) -> str:
    return f"m{-c}" if c < 0 else str(c)


def _f1c(c: int) -> Column:
    k = _suffix(c)
    return f1_expr(F.col(f"tp_{k}"), F.col(f"np_{k}"), F.col(f"ns_{k}"))


# R1 ------------------------------------------------------------------------

def predict_label(df: DataFrame, logits: str = "logits", out: str = "p",
                  prob_out: str | None = None) -> DataFrame:
    """Index of the largest logit (lowest index on ties). Softmax does not
    change the argmax; it is only produced as an optional probability column."""
    lg = F.col(logits)
    res = df.withColumn(out, (F.array_position(lg, F.array_max(lg)) - 1).cast("int"))
    if prob_out:
        mx = F.array_max(lg)
        exps = F.transform(lg, lambda v: F.exp(v - mx))
        total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
        res = res.withColumn(prob_out, F.transform(exps, lambda v: v / total))
    return res


# R2 / R3 -------------------------------------------------------------------

def confusion(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(*by, y, p).agg(F.count(F.lit(1)).alias("n"))


def class_stats(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p",
                classes: Sequence[int] = CLASSES) -> DataFrame:
    """(by..., cls, tp, n_pred, n_true, n_rows) from one aggregation pass."""
    wide = _wide_counts(df, by, y, p, classes)
    rows = [F.struct(F.lit(c).alias("cls"), F.col(f"tp_{_suffix(c)}").alias("tp"),
                     F.col(f"np_{_suffix(c)}").alias("n_pred"), F.col(f"ns_{_suffix(c)}").alias("n_true"))
            for c in classes]
    return wide.select(*by, "n_rows", F.inline(F.array(*rows)))


def class_prf(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p",
              classes: Sequence[int] = CLASSES) -> DataFrame:
    st = class_stats(df, by, y, p, classes)
    return st.select(
        *by, "cls", "tp", "n_pred", "n_true",
        _ratio(F.col("tp"), F.col("n_pred")).alias("precision"),
        _ratio(F.col("tp"), F.col("n_true")).alias("recall"),
        f1_expr(F.col("tp"), F.col("n_pred"), F.col("n_true")).alias("f1"),
    )


# R4-R8 ---------------------------------------------------------------------

def f1_avg2(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", out: str = "f1_avg2") -> DataFrame:
    """(F1 of class 0 + F1 of class 2) / 2; class 1 still counts as an error source."""
    w = _wide_counts(df, by, y, p, CLASSES)
    return w.select(*by, ((_f1c(0) + _f1c(2)) / 2).alias(out))


def f1_avg3(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", out: str = "f1_avg3") -> DataFrame:
    w = _wide_counts(df, by, y, p, CLASSES)
    return w.select(*by, ((_f1c(0) + _f1c(1) + _f1c(2)) / 3).alias(out))


def f1_micro(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p",
             labels: Sequence[int] | None = None) -> DataFrame:
    """Pooled P/R/F1. Without a label list every class counts (= accuracy);
    with labels 0-2 a -1 prediction lowers n_pred only, so P != R."""
    if labels is None:
        w = _wide_counts(df, by, y, p, ())
        acc = _ratio(F.col("n_correct"), F.col("n_rows"))
        return w.select(*by, acc.alias("micro_precision"), acc.alias("micro_recall"), acc.alias("micro_f1"))
    w = _wide_counts(df, by, y, p, labels)
    tp = sum((F.col(f"tp_{_suffix(c)}") for c in labels), F.lit(0))
    npred = sum((F.col(f"np_{_suffix(c)}") for c in labels), F.lit(0))
    ntrue = sum((F.col(f"ns_{_suffix(c)}") for c in labels), F.lit(0))
    return w.select(*by, _ratio(tp, npred).alias("micro_precision"), _ratio(tp, ntrue).alias("micro_recall"),
                    f1_expr(tp, npred, ntrue).alias("micro_f1"))


def present_class_stats(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """(by..., cls, tp, n_pred, n_true) for every class that occurs in y or p,
    whatever its number, built from the confusion counts."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col(y).cast("int").alias("cls"), F.when(F.col(y) == F.col(p), n).otherwise(zero).alias("tp"),
                 zero.alias("n_pred"), n.alias("n_true")),
        F.struct(F.col(p).cast("int").alias("cls"), zero.alias("tp"), n.alias("n_pred"), zero.alias("n_true")))
    return (confusion(df, by, y, p).select(*by, F.inline(sides)).where(F.col("cls").isNotNull())
            .groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_true")]))


def f1_macro(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p",
             labels: Sequence[int] | None = None) -> DataFrame:
    """(a) labels=None: mean over the classes present in y or p (a -1
    prediction is then a class with F1 0); (b) fixed labels: absent ones are 0."""
    if labels is None:
        tp, n_pred, n_true = F.col("tp"), F.col("n_pred"), F.col("n_true")
        return present_class_stats(df, by, y, p).groupBy(*by).agg(
            F.avg(_ratio(tp, n_pred)).alias("macro_precision"), F.avg(_ratio(tp, n_true)).alias("macro_recall"),
            F.avg(f1_expr(tp, n_pred, n_true)).alias("macro_f1"))
    classes = list(labels)
    w = _wide_counts(df, by, y, p, classes)
    f1s = [_f1c(c) for c in classes]
    prec = [_ratio(F.col(f"tp_{_suffix(c)}"), F.col(f"np_{_suffix(c)}")) for c in classes]
    rec = [_ratio(F.col(f"tp_{_suffix(c)}"), F.col(f"ns_{_suffix(c)}")) for c in classes]
    k = F.lit(float(len(classes)))
    return w.select(*by, (sum(prec, F.lit(0.0)) / k).alias("macro_precision"),
                    (sum(rec, F.lit(0.0)) / k).alias("macro_recall"),
                    (sum(f1s, F.lit(0.0)) / k).alias("macro_f1"))


def accuracy(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    hit = F.when(F.col(y) == F.col(p), F.lit(1.0)).otherwise(F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"),
                               F.count(F.lit(1)).alias("n_rows"))


# R9 / R10 / R14 ----------------------------------------------------------

def seed_summary(df: DataFrame, keys: Sequence[str], seed: str = "seed", value: str = "value") -> DataFrame:
    """One row per (keys, seed) plus a mean row per keys (seed null, is_mean 1)."""
    return (df.groupingSets([[*keys, seed], list(keys)], *keys, seed)
            .agg(F.avg(value).alias(value), F.grouping(seed).alias("is_mean")))


def column_letter(n: Column) -> Column:
    """Spreadsheet column name of a 1-based ordinal: its digits in bijective
    base 26, A = 1 to Z = 26, without a zero, of any length (AAA after ZZ)."""
    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("name"))

    def digit(state, _):
        rest = state["rest"] - 1
        return F.when(state["rest"] <= 0, state).otherwise(F.struct(
            F.floor(rest / F.lit(26)).cast("long").alias("rest"),
            F.concat(F.char(F.lit(65) + F.pmod(rest, F.lit(26))), state["name"]).alias("name")))

    # 11 digits hold every ordinal up to 2^50
    return F.aggregate(F.sequence(F.lit(1), F.lit(11)), start, digit, lambda state: state["name"])


def results_wide(df: DataFrame, run_keys: Sequence[str], seed: str = "seed", value: str = "value",
                 seeds: Sequence[int] = (1, 2, 3), first_column: int = 2) -> DataFrame:
    """One output row per run: header cells, one value per listed seed and the
    mean over the seeds that are there, plus the spreadsheet column the run
    lands in (runs ordered by run_keys). A seed outside the list is an error,
    raised inside the plan.

    The ordinal window runs over the aggregated runs table (one row per run)."""
    listed = F.col(seed).isin(*seeds)
    runs = df.groupBy(*run_keys).agg(
        *[F.first(F.when(F.col(seed) == s, F.col(value)), ignorenulls=True).alias(f"seed_{s}") for s in seeds],
        F.max(F.when(F.coalesce(listed, F.lit(False)), F.lit(None))
              .otherwise(F.coalesce(F.col(seed).cast("string"), F.lit("null")))).alias("_other"))
    cells = F.filter(F.array(*[F.col(f"seed_{s}") for s in seeds]), lambda v: v.isNotNull())
    mean = F.aggregate(cells, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(cells), F.lit(0))
    checked = F.when(F.col("_other").isNotNull(), F.raise_error(F.concat(F.lit("seed not listed: "), F.col("_other")))
                     .cast("double")).otherwise(mean)
    ordinal = F.dense_rank().over(Window.orderBy(*run_keys)) + F.lit(first_column - 1)
    return runs.withColumn("mean", checked).withColumn("column", column_letter(ordinal)).drop("_other")


def target_seed_matrix(df: DataFrame, target: str = "target", seed: str = "seed", y: str = "y", p: str = "p",
                       metric: str = "avg2") -> DataFrame:
    per = f1_per_target(df, target=target, by=[seed], y=y, p=p, metric=metric)
    return seed_summary(per, [target], seed=seed, value="f1")


# R11 / R12 / R13 -----------------------------------------------------------

def f1_per_target(df: DataFrame, target: str = "target", by: Sequence[str] = (), y: str = "y", p: str = "p",
                  metric: str = "avg2") -> DataFrame:
    w = _wide_counts(df, [*by, target], y, p, CLASSES)
    val = (_f1c(0) + _f1c(2)) / 2 if metric == "avg2" else (_f1c(0) + _f1c(1) + _f1c(2)) / 3
    return w.select(*by, target, "n_rows", val.alias("f1"))


def f1_by_ranges(df: DataFrame, ranges: Sequence[tuple[str, int, int]], idx: str = "idx",
                 by: Sequence[str] = (), y: str = "y", p: str = "p", metric: str = "avg2") -> DataFrame:
    """Positional slices [lo, hi) of an indexed frame (the reference's
    per-target form). The slices are a short literal spec, so each becomes a
    set of conditional counters in the same single aggregation: no join, and
    every slice reports a row, an empty one with n_rows 0 and F1 0."""
    yc, pc, ic = F.col(y), F.col(p), F.col(idx)
    aggs = []
    for r, (_name, lo, hi) in enumerate(ranges):
        inside = (ic >= lo) & (ic < hi)
        aggs.append(F.count_if(inside).alias(f"n_{r}"))
        for c in CLASSES:
            aggs += [F.count_if(inside & (yc == c) & (pc == c)).alias(f"tp_{r}_{c}"),
                     F.count_if(inside & (pc == c)).alias(f"np_{r}_{c}"),
                     F.count_if(inside & (yc == c)).alias(f"ns_{r}_{c}")]
    wide = df.groupBy(*by).agg(*aggs)

    def f1(r, c):
        return f1_expr(F.col(f"tp_{r}_{c}"), F.col(f"np_{r}_{c}"), F.col(f"ns_{r}_{c}"))

    rows = []
    for r, (name, _lo, _hi) in enumerate(ranges):
        val = (f1(r, 0) + f1(r, 2)) / 2 if metric == "avg2" else (f1(r, 0) + f1(r, 1) + f1(r, 2)) / 3
        rows.append(F.struct(F.lit(name).alias("range_name"), F.col(f"n_{r}").alias("n_rows"), val.alias("f1")))
    return wide.select(*by, F.inline(F.array(*rows)))


#: Ranges that rows find by a search of one array; beyond, by a join on blocks of the index.
SEARCHED_RANGES = 100_000
#: An index block spans 2^BLOCK_BITS positions.
BLOCK_BITS = 16


def ranges_by_target(df: DataFrame, target: str = "target") -> DataFrame:
    """The slices that a file sorted by target falls into, from running counts
    of the targets: range_name, lo, hi (one row per target)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    hi = F.sum("_n").over(Window.orderBy(F.col(target).asc_nulls_first()))
    return counts.select(F.col(target).alias("range_name"), (hi - F.col("_n")).alias("lo"), hi.alias("hi"))


def with_range(df: DataFrame, ranges: DataFrame, idx: str = "idx", searched: int = SEARCHED_RANGES) -> DataFrame:
    """``df`` + range_name, the range [lo, hi) that holds the row's index; rows in
    none are left out. Ranges do not overlap; there may be any number of them."""
    ranges = ranges.select("range_name", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    n = ranges.count()
    at = F.col(idx).cast("long")
    if not n:
        return df.withColumn("range_name", F.lit(None).cast(ranges.schema["range_name"].dataType)).where(F.lit(False))
    if n > searched:
        blocks = ranges.where("hi > lo").withColumn("_block", F.explode(F.sequence(
            F.shiftright("lo", BLOCK_BITS), F.shiftright(F.col("hi") - 1, BLOCK_BITS))))
        return df.withColumn("_block", F.shiftright(at, BLOCK_BITS)).join(blocks, "_block") \
            .where((at >= F.col("lo")) & (at < F.col("hi"))).drop("_block", "lo", "hi")
    table = ranges.where("hi > lo").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "range_name"))).alias("t")).scalar()
    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)])
    held = F.col("_ranges")
    # how many ranges start at or before the row: the largest power of two first
    found = F.aggregate(steps, F.lit(0), lambda pos, step: F.when(
        F.coalesce(F.get(held, pos + step - 1)["lo"] <= at, F.lit(False)), pos + step).otherwise(pos))
    mine = df.withColumn("_ranges", table).withColumn("_range", F.get(held, found - 1))
    return mine.where(at < F.col("_range.hi")).withColumn("range_name", F.col("_range.range_name")).drop("_ranges", "_range")


def f1_by_range_table(df: DataFrame, ranges: DataFrame, idx: str = "idx", by: Sequence[str] = (), y: str = "y",
                      p: str = "p", metric: str = "avg2") -> DataFrame:
    """R12 for ranges given as a frame (range_name, lo, hi): every row meets its
    range by search, and one aggregation scores all ranges. Ranges without rows
    have no row."""
    return f1_per_target(with_range(df, ranges, idx), "range_name", by, y, p, metric)


def error_rows(df: DataFrame, y: str = "y", p: str = "p", domain: str = "polarity",
               only_errors: bool = True) -> DataFrame:
    res = df.withColumn("gold_label", decode_label(y, domain)).withColumn("pred_label", decode_label(p, domain))
    return res.filter(~F.col(y).eqNullSafe(F.col(p))) if only_errors else res


# R15 / R16 / T6 ------------------------------------------------------------

def best_checkpoint(df: DataFrame, run_keys: Sequence[str], epoch: str = "epoch", value: str = "f1") -> DataFrame:
    """Keep an epoch only when strictly better than every earlier one, starting
    from 0: the first epoch reaching the run's maximum; a run never above 0
    keeps none. Window over the per-epoch metric table (one row per epoch)."""
    w = Window.partitionBy(*run_keys).orderBy(F.col(value).desc(), F.col(epoch).asc())
    return (df.filter(F.col(value) > 0).withColumn("_rk", F.row_number().over(w))
            .filter(F.col("_rk") == 1).drop("_rk"))


def early_stop(df: DataFrame, run_keys: Sequence[str], epoch: str = "epoch", loss: str = "eval_loss",
               patience: int = 1) -> DataFrame:
    """Stop after ``patience`` evaluations in a row without a strictly lower
    eval loss; the best (first minimum) epoch up to the stop is reloaded.
    Output: run keys, stop_epoch, best_epoch, best_loss."""
    order = Window.partitionBy(*run_keys).orderBy(epoch)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    prev_best = F.min(loss).over(before)
    marked = df.withColumn("_imp", (prev_best.isNull() | (F.col(loss) < prev_best)).cast("int"))
    marked = marked.withColumn("_grp", F.sum("_imp").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.row_number().over(Window.partitionBy(*run_keys, "_grp").orderBy(epoch)) - 1
    marked = marked.withColumn("_streak", streak)
    stops = marked.groupBy(*run_keys).agg(
        F.coalesce(F.min(F.when(F.col("_streak") >= patience, F.col(epoch))), F.max(epoch)).alias("stop_epoch"))
    within = marked.join(stops, list(run_keys)).filter(F.col(epoch) <= F.col("stop_epoch"))
    best = within.groupBy(*run_keys, "stop_epoch").agg(
        F.min_by(F.col(epoch), F.struct(F.col(loss), F.col(epoch))).alias("best_epoch"),
        F.min(loss).alias("best_loss"))
    return best


def best_config(df: DataFrame, group_keys: Sequence[str], config_keys: Sequence[str], value: str = "mean") -> DataFrame:
    """The configuration with the best value per group; ties go to the
    smallest config keys."""
    order = [F.col(value).desc()] + [F.col(k).asc() for k in config_keys]
    w = Window.partitionBy(*group_keys).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk")


# R17 -----------------------------------------------------------------------

def _scores(df: DataFrame, explainer: str, evaluator: str, score: str, evaluators: Sequence[str]) -> DataFrame:
    """One row per explainer: a struct (mean, std) per listed evaluator. An
    evaluator outside the list is an error, raised inside the plan."""
    name = F.col(evaluator)
    known = F.when(F.coalesce(name.isin(*evaluators), F.lit(False)), name).otherwise(
        F.raise_error(F.concat(F.lit("evaluator not listed: "), F.coalesce(name, F.lit("null")))))
    per = df.select(F.col(explainer), known.alias("_ev"), F.col(score).alias("_score")) \
        .groupBy(explainer, "_ev").agg(F.struct(F.avg("_score").alias("mean"),
                                                F.stddev_pop("_score").alias("std")).alias("_s"))
    return per.groupBy(explainer).pivot("_ev", list(evaluators)).agg(F.first("_s"))


def _kept(wide: DataFrame, evaluators: Sequence[str]) -> dict[str, list[str]]:
    """Evaluators with a value, per table: one tiny aggregate row."""
    counts = wide.agg(*[F.count(F.col(f"`{e}`.{stat}")).alias(f"{stat}:{e}") for stat in ("mean", "std")
                        for e in evaluators]).first()
    return {stat: [e for e in evaluators if counts[f"{stat}:{e}"] > 0] for stat in ("mean", "std")}


def score_summary(df: DataFrame, explainer: str, evaluator: str, score: str,
                  evaluators: Sequence[str]) -> DataFrame:
    """Mean and population std per (explainer, evaluator); explainers as
    rows, one column per evaluator, a ``stat`` column tells the two tables
    apart. Columns that are null for every explainer in a table are dropped
    from that table only (the std table is filtered independently)."""
    wide = _scores(df, explainer, evaluator, score, evaluators)
    kept = _kept(wide, evaluators)
    columns = [e for e in evaluators if any(e in k for k in kept.values())]
    rows = [F.struct(F.lit(stat).alias("stat"), *[
        (F.col(f"`{e}`.{stat}") if e in kept[stat] else F.lit(None).cast("double")).alias(e) for e in columns])
        for stat in ("mean", "std")]
    return wide.select(explainer, F.inline(F.array(*rows))).select("stat", explainer, *columns)


def score_tables(df: DataFrame, explainer: str, evaluator: str, score: str,
                 evaluators: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """R17 as two tables (mean, std), explainers as rows, one column per
    evaluator; each table drops its own all-null columns."""
    wide = _scores(df, explainer, evaluator, score, evaluators)
    kept = _kept(wide, evaluators)
    mean, std = (wide.select(explainer, *[F.col(f"`{e}`.{stat}").alias(e) for e in kept[stat]])
                 for stat in ("mean", "std"))
    return mean, std


# R18 -----------------------------------------------------------------------

POLICIES = {
    # dataset -> (aux, per-class average when not aux)
    "SemEval2016": "avg2",
    "PStance": "avg2",
    "Covid19": "avg3",
    "vast": "avg2",
}
STANCE_CLASS_NAMES = ("Against", "None", "Favor")


def count_columns(classes: Sequence[int] = CLASSES) -> list[str]:
    cols = ["n_rows", "n_correct"]
    for c in classes:
        k = _suffix(c)
        cols += [f"tp_{k}", f"np_{k}", f"ns_{k}"]
    return cols


def roll_up(counts: DataFrame, by: Sequence[str], classes: Sequence[int] = CLASSES) -> DataFrame:
    """Counters at a coarser grain: sums over the (small) counter table, so
    one aggregation of the data serves every level."""
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in count_columns(classes)])


def evaluate(df: DataFrame, dataset: str, aux_eval: bool = False, metric: str = "micro",
             per_target: bool = False, target: str = "target", by: Sequence[str] = (),
             y: str = "y", p: str = "p", fixed_labels: bool = False,
             counts: DataFrame | None = None) -> DataFrame:
    """The dataset metric policy as one long table (by..., scope, name, value).

    not aux: (F1_0 + F1_2)/2, or the three-class mean for Covid19.
    aux (VAST): micro or macro F1 (fixed labels 0-2 when ``fixed_labels``,
    else every class / present classes). per_target: per-target values,
    except VAST, which reports per-class F1 named Against/None/Favor in the
    aux case and nothing more otherwise.

    The data is aggregated once, to counters per (by, target); the overall
    values are roll-ups of that small table. Pass ``counts`` (from
    ``target_counts``) to share one aggregation between several policies.
    """
    avg = POLICIES.get(dataset, "avg2")
    classes = list(CLASSES) + ([] if fixed_labels or not aux_eval or metric == "micro" else [-1])
    fine = counts if counts is not None else target_counts(df, by, target, y, p, classes)
    w = roll_up(fine, by, classes)
    f0, f1c, f2 = _f1c(0), _f1c(1), _f1c(2)
    if not aux_eval:
        value = (f0 + f1c + f2) / 3 if avg == "avg3" else (f0 + f2) / 2
    elif metric == "micro":
        if fixed_labels:
            tp = F.col("tp_0") + F.col("tp_1") + F.col("tp_2")
            value = f1_expr(tp, F.col("np_0") + F.col("np_1") + F.col("np_2"),
                            F.col("ns_0") + F.col("ns_1") + F.col("ns_2"))
        else:
            value = _ratio(F.col("n_correct"), F.col("n_rows"))
    elif fixed_labels:
        value = (f0 + f1c + f2) / 3
    else:
        present = [((F.col(f"np_{_suffix(c)}") + F.col(f"ns_{_suffix(c)}")) > 0).cast("double") for c in classes]
        n_present = sum(present, F.lit(0.0))
        tot = sum((_f1c(c) * pr for c, pr in zip(classes, present)), F.lit(0.0))
        value = F.when(n_present > 0, tot / n_present).otherwise(F.lit(0.0))
    result = w.select(*by, F.lit("overall").alias("scope"), F.lit(metric if aux_eval else avg).alias("name"),
                      value.alias("value"))
    if per_target and (aux_eval or dataset != "vast"):
        if dataset == "vast":
            rows = [F.struct(F.lit(n).alias("name"), _f1c(c).alias("value"))
                    for c, n in zip(CLASSES, STANCE_CLASS_NAMES)]
            extra = w.select(*by, F.lit("class").alias("scope"), F.inline(F.array(*rows)))
        else:
            tv = (f0 + f1c + f2) / 3 if avg == "avg3" else (f0 + f2) / 2
            extra = fine.select(*by, F.lit("target").alias("scope"), F.col(target).alias("name"), tv.alias("value"))
        result = result.unionByName(extra)
    return result


def target_counts(df: DataFrame, by: Sequence[str] = (), target: str = "target", y: str = "y", p: str = "p",
                  classes: Sequence[int] = (-1, 0, 1, 2)) -> DataFrame:
    """Counters per (by, target): the one aggregation every policy reads."""
    return _wide_counts(df, [*by, target], y, p, classes)
