import ast
from pathlib import Path

import corpus_pipeline
import public_tokenizers
from llm_help import EDGES, SF, frame
from test_secrets import brute as brute_secrets
from test_simhash import fingerprint, merged
from tokenizers import Tokenizer

from stanceflow.llm import queries
from stanceflow.llm.common import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_do_what_they_say(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "secret_scans",
                                                      "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, good, single, clean, mixed, ids = stages(spark, docs)
    for df in (good, single, clean, mixed):
        assert df.columns == COLUMNS
    rows = {n: {r.doc_id: r for r in df.collect()} for n, df in
            (("start", start), ("good", good), ("single", single), ("clean", clean), ("mixed", mixed), ("ids", ids))}
    # classifier: rejected documents are mostly labelled bad, good ones stay
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept_good = [i in rows["good"] for i, q in labels.items() if q == 1]
    assert sum(kept_good) >= 0.95 * len(kept_good) and len(rows["good"]) < len(rows["start"])
    # near duplicates: the smallest key of each group, by brute force
    prints = [(i, fingerprint(r.text)) for i, r in rows["good"].items()]
    links = [(a, b) for n, (a, p) in enumerate(prints) for b, q in prints[n + 1:] if (p ^ q).bit_count() <= 3]
    assert set(rows["single"]) == set(merged(set(rows["good"]), links).values())
    # secrets: none is left, clean rows are unchanged
    for i, r in rows["clean"].items():
        if sum(brute_secrets(rows["single"][i].text)[:3]):
            assert sum(brute_secrets(r.text)[:3]) == 0 and r.text != rows["single"][i].text
            assert r.n_chars == len(r.text)
        else:
            assert r == rows["single"][i]
    assert set(rows["clean"]) == set(rows["single"])
    # mixing draws rows as they are; encoding covers all that is left
    assert 0 < len(rows["mixed"]) < len(rows["clean"])
    assert all(r == rows["clean"][i] for i, r in rows["mixed"].items())
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {i: r.n_tokens for i, r in rows["ids"].items()} \
        == {i: len(tok.encode(r.text, add_special_tokens=False).ids) for i, r in rows["mixed"].items()}


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = sorted(map(tuple, stages(spark, docs)[-1].collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == last


def test_stages_take_odd_and_empty_tables(spark):
    for rows in (EDGES, []):
        out = stages(spark, frame(spark, rows, extra=True))
        assert out[-2].columns == out[0].columns


def test_each_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for path in [*root.glob("stanceflow/**/*.py"), *root.glob("tools/*.py"), root / "bench.py", *root.glob("tests/*.py")]:
        if "llm" in path.parent.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else \
                [f"{node.module}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("stanceflow.llm", "corpus_pipeline")) for n in names), path
