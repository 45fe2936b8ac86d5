"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

A document is a sparse vector x: its words hashed to ``WORD_SLOTS`` slots with
damped, length-normalised counts, one slot per bin of each structure statistic
(length, symbols, capitals, repeated lines, ...) and one per bin of the
metadata ``n_chars``. The score is the logistic of

    w0 + <w, x> + 1/2 * sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

which is linear in the number of features (the sum-of-squares identity for all
pairwise interactions <v_i, v_j> x_i x_j).

Training: labelled documents of the training folds, at most ``sample`` of them
on average (a documented bound: rows are taken by a hash of their key, so any
task order gives the same rows). Their features, a few MB, are fitted by Adam
in one task; the model has a fixed size and is broadcast. Scoring runs over all
documents.

Defined results: null and empty texts have structure features only and get a
score too; a null ``n_chars`` is a bin of its own; labels with null quality are
no training rows; without training rows of both classes the score is the share
of label 1 (one half without any); repeated rows are rows of their own; an
empty table gives an empty frame; labels, lang, source and keys are no inputs.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceflow.llm.bpe import slices
from stanceflow.llm.common import LOWER_ASCII, Shared, free_name, release_memory

WORD_SLOTS = 1 << 14
FACTORS = 8
SAMPLE = 8_000
EPOCHS = 12
SEED = 7

#: Bin edges of the structure statistics, in the order of ``statistics``.
EDGES = (
    ("words", (1, 5, 20, 50, 100, 300, 1000, 5000)),
    ("symbols per word", (0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)),
    ("bangs per word", (0.005, 0.02, 0.05, 0.1, 0.25, 0.5)),
    ("capitals per letter", (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)),
    ("repeated lines", (0.01, 0.05, 0.1, 0.2, 0.3, 0.5)),
    ("distinct words", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    ("word length", (1, 2, 3, 4, 5, 6, 7, 8, 10, 14)),
    ("digits per word", (0.01, 0.05, 0.2, 0.5, 1)),
    ("words per line", (1, 2, 5, 10, 20, 50, 200)),
    ("repeated windows", (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)),
    ("metadata: characters", (0, 50, 200, 500, 1000, 2000, 4000, 10000, 50000)),
)
BASE_SLOTS = np.cumsum([WORD_SLOTS, *[len(e) + 2 for _, e in EDGES]])
SLOTS = int(BASE_SLOTS[-1])

SYMBOL_BYTES = bytes(b for b in range(256) if b not in b"#*$%&|<>{}[]\\^~_=+@")
NOT = {"bang": bytes(b for b in range(256) if b not in b"!"),
       "upper": bytes(b for b in range(256) if not 65 <= b <= 90),
       "letter": bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122)),
       "digit": bytes(b for b in range(256) if not 48 <= b <= 57)}


def statistics(data: bytes, words: list[bytes], hashes: np.ndarray) -> list[float]:
    """The structure statistics of a text (UTF-8), see ``EDGES``."""
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = len(data.translate(None, NOT["letter"]))
    windows = hashes[:-2] * 31 * 31 + hashes[1:-1] * 31 + hashes[2:] if len(hashes) > 2 else hashes[:0]
    return [
        len(words), len(data.translate(None, SYMBOL_BYTES)) / n, len(data.translate(None, NOT["bang"])) / n,
        len(data.translate(None, NOT["upper"])) / max(1, letters), 1 - len(set(lines)) / max(1, len(lines)),
        len(np.unique(hashes)) / n, sum(map(len, words)) / n, len(data.translate(None, NOT["digit"])) / n,
        len(words) / max(1, len(lines)), 1 - len(np.unique(windows)) / max(1, len(windows)),
    ]


def featurize(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of one document, slots distinct."""
    data = text.encode()
    words = data.translate(LOWER_ASCII).split()
    hashes = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words))
    slots, counts = np.unique(hashes & (WORD_SLOTS - 1), return_counts=True)
    values = np.log1p(counts).astype(np.float32)
    if len(values):
        values /= np.sqrt((values * values).sum())
    stats = [*statistics(data, words, hashes), n_chars]
    bins = [base + (len(edges) + 1 if s is None else int(np.searchsorted(edges, s, side="right")))
            for s, base, (_, edges) in zip(stats, BASE_SLOTS[:-1].tolist(), EDGES, strict=True)]
    return (np.concatenate([slots, np.array(bins)]).astype(np.int32),
            np.concatenate([values, np.full(len(bins), 0.5, dtype=np.float32)]))


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of documents whose features are concatenated; every one has some."""
        vx = self.factor[slots] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        linear = np.add.reduceat(self.weight[slots] * values, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        sizes = np.array([len(s) for s, _ in rows])
        z = self.logits(np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]),
                        np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, factors: int = FACTORS,
        rate: float = 0.02, decay: float = 1e-4, batch: int = 128, seed: int = SEED) -> Model:
    """Adam on the logistic loss; both classes have the same total weight."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        logit = 60.0 * (share - 0.5)
        return Model(logit, np.zeros(SLOTS, np.float32), np.zeros((SLOTS, factors), np.float32))
    rng = np.random.default_rng(seed)
    params = np.zeros((SLOTS, factors + 1), dtype=np.float32)
    params[:, 1:] = rng.normal(0, 0.01, (SLOTS, factors))
    bias = 0.0
    m, s, mb, sb, step = np.zeros_like(params), np.zeros_like(params), 0.0, 0.0, 0
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            sizes = np.array([len(rows[i][0]) for i in pick])
            slots = np.concatenate([rows[i][0] for i in pick])
            values = np.concatenate([rows[i][1] for i in pick])[:, None]
            starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(pick)), sizes)
            p = params[slots]
            vx = p[:, 1:] * values
            sums = np.add.reduceat(vx, starts, axis=0)
            z = bias + np.add.reduceat(p[:, 0] * values[:, 0], starts) \
                + 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts, axis=0)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * importance[pick] / len(pick)
            grad = np.empty_like(p)
            grad[:, 0] = err[owner] * values[:, 0]
            grad[:, 1:] = err[owner][:, None] * values * (sums[owner] - vx)
            used, inverse = np.unique(slots, return_inverse=True)
            g = np.zeros((len(used), factors + 1), dtype=np.float32)
            np.add.at(g, inverse, grad)
            g += decay * params[used]
            step += 1
            m[used] = 0.9 * m[used] + 0.1 * g
            s[used] = 0.999 * s[used] + 0.001 * g * g
            fix = np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            params[used] -= rate * fix * m[used] / (np.sqrt(s[used]) + 1e-8)
            gb = float(err.sum())
            mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
            bias -= rate * fix * mb / (np.sqrt(sb) + 1e-8)
    return Model(float(bias), params[:, 0].copy(), params[:, 1:].copy())


FEATURES = T.StructType([T.StructField("slots", T.BinaryType()), T.StructField("vals", T.BinaryType()),
                         T.StructField("label", T.IntegerType())])


def _metadata(df: DataFrame) -> Column:
    return F.col("n_chars").cast("bigint") if "n_chars" in df.columns else F.lit(None).cast("bigint")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows of ``docs``, about ``sample`` of them at most."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key) \
        .agg(F.min(label).cast("int").alias("_label"))
    n = marks.count()
    if n > sample:
        cut = int(sample / n * (1 << 32))
        marks = marks.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 32)) < cut)
    rows = docs.select(F.col(key), F.col(text).alias("_text"), _metadata(docs).alias("_meta")).join(marks, key)

    def features(batches):
        for batch in batches:
            meta, label = batch.column(1).to_pylist(), batch.column(2)
            for at, texts in slices(batch.column(0)):
                made = [featurize(t, meta[at + i]) for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.tobytes() for s, _ in made], pa.binary()),
                     pa.array([v.tobytes() for _, v in made], pa.binary()), label.slice(at, len(texts))],
                    names=["slots", "vals", "label"])

    def learn(table: pa.Table) -> pa.Table:
        # any order of arrival gives the same model
        order = sorted(zip(table["slots"].to_pylist(), table["vals"].to_pylist(), table["label"].to_pylist(), strict=True))
        data = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for s, v, _ in order]
        model = fit(data, np.array([x for _, _, x in order], dtype=np.float32))
        return pa.table({"bias": pa.array([model.bias]), "weight": pa.array([model.weight.tobytes()]),
                         "factor": pa.array([model.factor.tobytes()])})

    # the sample is bounded, so one task may hold its features
    fitted = rows.select("_text", "_meta", "_label").mapInArrow(features, FEATURES).groupBy() \
        .applyInArrow(learn, "bias double, weight binary, factor binary").collect()
    if not fitted:
        return fit([], np.zeros(0, np.float32))
    bias, weight, factor = fitted[0]
    return Model(bias, np.frombuffer(weight, np.float32), np.frombuffer(factor, np.float32).reshape(SLOTS, -1))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
          out: str = "score") -> DataFrame:
    """``keep`` columns + the score of every document."""
    shared = Shared(docs.sparkSession, model)  # a fixed number of slots
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.DoubleType())])
    n = len(keep)
    sent = [F.col(c) for c in keep] + ([] if text in keep else [F.col(text)])
    place = keep.index(text) if text in keep else n

    def run(batches):
        for batch in batches:
            meta = batch.column(batch.num_columns - 1).to_pylist()
            made: list[float] = []
            for at, texts in slices(batch.column(place)):
                made += shared().scores([featurize(t, meta[at + i]) for i, t in enumerate(texts)]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, pa.float64())],
                                             names=[*batch.schema.names[:n], out])
        release_memory()

    body = docs.select(*sent, _metadata(docs).alias(free_name("_meta", [*keep, text])))
    return body.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Every third key by the CRC-32 of its text form is not trained on."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``."""
    out = free_name("_score", docs.columns)
    model = train(docs, labels.where(~held_out()))
    return score(docs, model, tuple(docs.columns), out=out).where(F.col(out) >= threshold).drop(out)
