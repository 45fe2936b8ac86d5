import re
from collections import Counter

from llm_help import EDGES, SF, documents, frame

from stanceflow.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


MORE = [(301, "a b c d a b c e\n\nx\nx\n x\n\t\n"), (302, "#*$ %&|<> {}"), (303, ("alpha beta gamma delta " * 5 + "\n") * 9),
        (304, "x " * 3), (305, "\U0001f600\U0001f600 é")]


def test_counts_equal_brute_force(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(frame(spark, EDGES + MORE))
    want = sorted(((r.doc_id or -1), *brute(r.text)) for r in docs.collect())
    got = sorted(((r.doc_id or -1), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                 for r in rules.digest(docs).collect())
    assert got == want


def test_posteriors_separate_the_labels(spark):
    out = rules.digest(documents(spark)).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    fit = [r for r in out if not r.base_failed]
    assert sum(r.kept == bool(r.quality) for r in fit) >= 0.97 * len(fit)
    assert not any(r.kept for r in out if r.base_failed)


def test_em_equals_a_plain_loop(spark):
    patterns = {"1-1": 50, "10-": 7, "0-0": 9, "-00": 12, "111": 30, "---": 3}
    df = spark.createDataFrame(list(patterns.items()), "votes string, n long")
    got = {r.votes: r.posterior for r in rules.posteriors(df, 3, iterations=5).collect()}
    prior, good, bad = 0.8, [list(rules.START_GOOD) for _ in range(3)], [list(rules.START_BAD) for _ in range(3)]

    def posterior(v):
        g, b = prior, 1 - prior
        for j, c in enumerate(v):
            g, b = g * good[j]["10-".index(c)], b * bad[j]["10-".index(c)]
        return g / (g + b)

    for _ in range(5):
        q = {v: posterior(v) for v in patterns}
        for table, start, weight in ((good, rules.START_GOOD, lambda v: patterns[v] * q[v]),
                                     (bad, rules.START_BAD, lambda v: patterns[v] * (1 - q[v]))):
            whole = sum(weight(v) for v in patterns) + 1
            new = [[(sum(weight(v) for v in patterns if v[j] == o) + s) / whole
                    for o, s in zip("10-", start, strict=True)] for j in range(3)]
            table[:] = new
        prior = (sum(patterns[v] * q[v] for v in patterns) + 0.8) / (sum(patterns.values()) + 1)
    for v in patterns:
        assert abs(got[v] - posterior(v)) < 1e-9


def test_edges(spark):
    out = {r.doc_id: r for r in rules.digest(frame(spark, EDGES, extra=True)).collect()}
    assert not out[1].kept and out[1].n_words == 0 and out[1].base_failed
    assert rules.digest(frame(spark, [])).count() == 0
