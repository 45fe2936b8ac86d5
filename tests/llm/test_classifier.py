import itertools
import zlib

import numpy as np
from llm_help import EDGES, frame

from stanceflow.llm import classifier as C

BIG = "/root/testdata/sf0.01"


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    model = C.Model(0.3, rng.normal(size=C.SLOTS).astype(np.float32),
                    rng.normal(0, 0.3, (C.SLOTS, 4)).astype(np.float32))
    rows = [C.featurize(t, n) for t, n in (("a b c a", 7), ("", None), ("One two\nthree!! ###", 19))]
    for (slots, values), score in zip(rows, model.scores(rows), strict=True):
        z = model.bias + float((model.weight[slots] * values).sum())
        for i, j in itertools.combinations(range(len(slots)), 2):
            z += float(model.factor[slots[i]] @ model.factor[slots[j]]) * float(values[i] * values[j])
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-5


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    out = C.digest(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.97
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_held_out_labels_change_nothing(spark):
    from pyspark.sql import functions as F
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet").limit(150), spark.read.parquet(f"{BIG}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(C.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = (sorted(map(tuple, C.digest(d, x).collect())) for d, x in ((docs, labels), (other, flipped)))
    assert a == b


def test_edges(spark):
    docs, labels = frame(spark, EDGES, extra=True), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = C.digest(docs, labels).collect()
    assert len(out) == len(EDGES) and {r.score for r in out} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in (3, 4, 4, 5, 6, 7, 8)] + [(2, None, 0), (None, 0, 0)], labels.schema)
    assert all(r.score > 0.99 for r in C.digest(docs, one).collect())
    kept = C.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(EDGES)
    assert C.digest(frame(spark, []), labels).count() == 0
