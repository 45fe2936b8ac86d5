"""Quality rules under weak supervision.

Each rule votes good (1), bad (0) or abstains (-1) on a document. The rules'
accuracies are not set by hand: expectation-maximisation estimates them from
how the rules agree over the whole corpus, and a document is kept if its
posterior probability of being good is at least one half, instead of passing
every rule.

Everything is DataFrame expressions. Word windows are counted inside the row
(sorted window hashes), so no word is shuffled. EM needs only the table of
vote patterns (at most 3^rules rows, whatever the corpus), collected into one
row and folded over with ``aggregate``; the posteriors go back to the documents
by a join on the pattern, whose size has that same bound.

Defined results: null and empty texts have no words, fail the base rules and
are not kept; texts under three words have no repeated windows; repeated rows
are rows of their own; an empty table gives an empty frame; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanceflow.llm.common import free_name, staged, words_array

# Fixed values of the base rules.
SYMBOLS = "[^#*$%&|<>]+"
MIN_WORDS = 50
REPEAT_PERCENT = 50


def features(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Key columns + counts per document (all bigint)."""
    names = {}
    for n in ("body", "words", "hashes", "sorted", "places", "lines"):
        names[n] = free_name("_" + n, keys)
    body, words, hashes, ordered, places, lines = (F.col(names[n]) for n in names)
    df = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias(names["body"]))
    df = df.withColumn(names["words"], words_array(body))
    n = F.size(words)
    # one 64-bit hash per window of three words (chance of a clash inside a
    # document of a million words: 3e-8)
    window = F.transform(F.sequence(F.lit(0), n - 3),
                         lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumn(names["hashes"], F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn(names["sorted"], F.when(repeats, F.sort_array(F.transform(
        hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))

    def twin(s, k):
        return F.coalesce(F.get(ordered, k + 1)["h"] == s["h"], F.lit(False)) \
            | F.coalesce(F.get(ordered, k - 1)["h"] == s["h"], F.lit(False))

    df = df.withColumn(names["places"], F.sort_array(F.transform(F.filter(ordered, twin), lambda s: s["i"])))
    covered = F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1), p + 3) - p)),
                          F.lit(0), lambda a, x: a + x)
    df = df.withColumn(names["lines"], F.filter(F.split(body, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    letters = F.length(F.regexp_replace(body, r"[^A-Za-z]+", ""))
    upper = F.length(F.regexp_replace(body, r"[^A-Z]+", ""))
    counts = {
        "n_words": n, "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(F.regexp_replace(body, SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered, "n_lines": F.size(lines), "n_letters": letters, "n_upper": upper,
        "n_bangs": F.length(F.regexp_replace(body, "[^!]+", "")),
        "n_distinct": F.size(F.array_distinct(words)),
    }
    return df.select(*keys, *[c.cast("bigint").alias(name) for name, c in counts.items()])


@dataclass(frozen=True)
class VoteRule:
    """bad / good: conditions on the counts; neither holds: the rule abstains."""

    name: str
    bad: Callable[[], Column]
    good: Callable[[], Column]


def vote_rules() -> tuple[VoteRule, ...]:
    """Rules that look for one kind of damage vote bad or abstain (its absence
    says little about other damage); the last two can also vote good."""

    def per(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    def defect(name: str, bad: Callable[[], Column]) -> VoteRule:
        return VoteRule(name, bad, lambda: F.lit(False))

    return (
        defect("symbols", lambda: per("n_symbols", "n_words") > 0.30),
        defect("repeated lines", lambda: per("n_dup_lines", "n_lines") > 0.30),
        defect("repeated windows", lambda: per("n_repeat_words", "n_words") > 0.30),
        defect("word length", lambda: (per("word_chars", "n_words") < 2.5) | (per("word_chars", "n_words") > 12)),
        defect("capitals", lambda: per("n_upper", "n_letters") > 0.50),
        defect("exclamations", lambda: per("n_bangs", "n_words") > 0.25),
        defect("variety", lambda: (F.col("n_words") >= MIN_WORDS) & (per("n_distinct", "n_words") < 0.15)),
        VoteRule("length", lambda: F.col("n_words") < MIN_WORDS, lambda: F.col("n_words") >= 2 * MIN_WORDS),
        VoteRule("plain prose", lambda: F.col("n_words") == 0,
                 lambda: (per("n_symbols", "n_words") < 0.20) & (per("n_upper", "n_letters") < 0.40)
                 & (per("n_bangs", "n_words") < 0.15) & (per("n_repeat_words", "n_words") < 0.30)
                 & per("word_chars", "n_words").between(2.5, 12)),
    )


def vote_column(rules: tuple[VoteRule, ...]) -> Column:
    """All votes as one short string key, a character per rule: 1, 0 or -."""
    return F.concat(*[F.when(r.bad(), F.lit("0")).when(r.good(), F.lit("1")).otherwise(F.lit("-")) for r in rules])


#: Starting chances of the votes 1, 0 and - on good and on bad documents.
START_GOOD = (0.50, 0.05, 0.45)
START_BAD = (0.10, 0.40, 0.50)


def posteriors(patterns: DataFrame, n_rules: int, iterations: int = 30, prior: float = 0.8) -> DataFrame:
    """EM over vote patterns (columns ``votes``, ``n``): votes, posterior, and
    the estimated ``model`` (prior, and for each class an array with the
    chances of the votes 1, 0, - of rule 0, of rule 1, ...). A rule's accuracy
    is its chance of voting right. Votes count as independent given the class;
    sums are smoothed by one document at the starting chances."""
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("p"))
    table = F.col("p")
    total = F.aggregate(table, F.lit(0.0), lambda a, x: a + x["n"])
    outcomes = "10-"

    def place(x, j):
        return 3 * j + F.instr(F.lit(outcomes), F.substring(x["votes"], j + 1, 1)) - 1

    def posterior(x, m):
        good, bad = m["prior"], 1 - m["prior"]
        for j in range(n_rules):
            good, bad = good * F.get(m["good"], place(x, j)), bad * F.get(m["bad"], place(x, j))
        return good / (good + bad)

    def weigh(p, m):
        return F.transform(p, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"),
                                                 posterior(x, m).alias("q")))

    def refit(rows):
        def weight(w, j=None, o=None):
            def add(a, x):
                hit = F.lit(True) if j is None else F.substring(x["votes"], j + 1, 1) == o
                return a + F.when(hit, w(x)).otherwise(0.0)
            return F.aggregate(rows, F.lit(0.0), add)

        good, bad = (lambda x: x["n"] * x["q"]), (lambda x: x["n"] * (1 - x["q"]))
        chances = [F.array(*[(weight(w, j, o) + s) / (weight(w) + 1)
                             for j in range(n_rules) for o, s in zip(outcomes, start, strict=True)])
                   for w, start in ((good, START_GOOD), (bad, START_BAD))]
        return F.struct(((weight(good) + prior) / (total + 1)).alias("prior"),
                        chances[0].alias("good"), chances[1].alias("bad"))

    start = F.struct(F.lit(float(prior)).alias("prior"),
                     F.array(*[F.lit(v) for v in START_GOOD * n_rules]).alias("good"),
                     F.array(*[F.lit(v) for v in START_BAD * n_rules]).alias("bad"))

    def step(m, _):
        # the one-element array binds the weighted patterns, so that the many
        # sums over them read one evaluation
        return F.get(F.transform(F.array(weigh(table, m)), refit), F.lit(0))

    fitted = one.withColumn("model", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step))
    return fitted.select(F.explode(weigh(table, F.col("model"))).alias("x"), "model") \
        .select(F.col("x.votes").alias("votes"), F.col("x.q").alias("posterior"), "model")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Key, counts, votes, posterior, base_failed and kept per document."""
    rules = vote_rules()
    feats = staged(features(docs, [key], text).withColumn("votes", vote_column(rules)), "rules")
    table = posteriors(feats.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), len(rules)) \
        .select("votes", "posterior")
    # at most 3^rules rows, whatever the corpus
    out = feats.join(F.broadcast(table), "votes")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed) \
        .withColumn("kept", ~failed & (F.col("posterior") >= threshold))


def digest(docs: DataFrame) -> DataFrame:
    return score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", "posterior", "votes")
