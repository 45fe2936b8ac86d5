"""Two heads over one shared representation, trained together (M1, M5).

A row is a unit vector of indexed term weights (no hashing). One matrix turns
it into ``width`` numbers that both heads read: task 0 rows feed the stance
head, task 1 rows the target-id head. The loss is the mean cross-entropy of the
task 0 rows plus ``aux_share`` times that of the task 1 rows, so both tasks move
the shared matrix. Every step is one pass over the staged rows: a task adds up
the gradient of its own rows, blocks of the gradients are summed by groups, and
the driver receives one gradient of the model's size, which ``terms`` bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceflow.operators.pairs import build_vocab, uniform_fallback
from stanceflow.session import staged

#: Gradient entries that are summed by one group.
GRADIENT_BLOCK = 1 << 16

#: Most entries of a model: it is sent to every task.
MODEL_SIZE = 1 << 24


def term_index(features: DataFrame, terms: int, width: int, seed: int) -> DataFrame:
    """(term, idx, start): the ``terms`` terms that most rows hold (ties: term
    ascending), numbered by the vocabulary operator, with the first values of
    their rows of the shared matrix."""
    held = build_vocab([features.select(F.array("term").alias("tokens"))], specials=())
    return held.where(F.col("idx") < terms).select(F.col("token").alias("term"), F.col("idx").cast("int").alias("idx"),
                                                   uniform_fallback(seed, F.col("token"), width).alias("start"))


def sparse_rows(features: DataFrame, index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with idx (array<int>, ascending) and weight (array<double>, of
    length 1): their indexed terms. A row without any has empty arrays. The
    index goes to every task: ``terms`` bounds it."""
    met = features.join(F.broadcast(index.select("term", "idx")), "term").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("_cells"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    norm = F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(F.lit(1.0))
    met = met.select(key, F.col("_cells.idx").alias("idx"),
                     F.transform("_cells", lambda c: c["weight"] / norm).alias("weight"))
    return rows.join(met, key, "left").withColumns({
        "idx": F.coalesce("idx", F.array().cast("array<int>")),
        "weight": F.coalesce("weight", F.array().cast("array<double>"))})


@dataclass
class Joint:
    """``shared`` (terms x width) and per task a head (width + 1 x classes; the
    last row is the bias)."""

    shared: np.ndarray
    heads: tuple[np.ndarray, np.ndarray]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.shared.ravel(), *[h.ravel() for h in self.heads]])

    def like(self, flat: np.ndarray) -> Joint:
        parts, at = [], 0
        for m in (self.shared, *self.heads):
            parts.append(flat[at:at + m.size].reshape(m.shape))
            at += m.size
        return Joint(parts[0], (parts[1], parts[2]))

    def hidden(self, idx: np.ndarray, weight: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """The shared numbers of n rows, and a 1 for the bias."""
        out = np.ones((n, self.shared.shape[1] + 1))
        for j in range(self.shared.shape[1]):
            out[:, j] = np.bincount(row, weight * self.shared[idx, j], n)
        return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idx, weight, row) of the cells of a batch's rows."""
    lists, weights = batch.column("idx"), batch.column("weight")
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(), weights.flatten().to_numpy(), np.repeat(np.arange(len(lists)), sizes)


def gradient(model: Joint, idx, weight, row, task, label, scale) -> tuple[np.ndarray, np.ndarray]:
    """(flat gradient, loss of each task) summed over some rows; ``scale``: a
    row's share in the loss, by task."""
    n = len(task)
    hidden = model.hidden(idx, weight, row, n)
    back = np.zeros((n, model.shared.shape[1]))
    heads, losses = [], np.zeros(2)
    for t in (0, 1):
        mine = np.flatnonzero(task == t)
        p = softmax(hidden[mine] @ model.heads[t])
        own = (np.arange(len(mine)), label[mine])
        losses[t] = -np.log(np.maximum(p[own], 1e-300)).sum()
        p[own] -= 1.0
        p *= scale[t]
        heads.append(hidden[mine].T @ p)
        back[mine] = p @ model.heads[t][:-1].T
    shared = np.stack([np.bincount(idx, weight * back[row, j], len(model.shared))
                       for j in range(model.shared.shape[1])], axis=1)
    return np.concatenate([shared.ravel(), *[h.ravel() for h in heads]]), losses


def fit(rows: DataFrame, index: DataFrame, classes: tuple[int, int], steps: int = 20, rate: float = 1.0,
        aux_share: float = 1.0) -> tuple[Joint, list[tuple[float, float]]]:
    """Gradient descent over all ``rows`` (idx, weight, task 0 or 1, label). Both
    heads start at zero. Returns the model and each step's mean losses by task
    (before the step). Runs one job a step; ``rows`` should be a written table."""
    spark = rows.sparkSession
    start = index.orderBy("idx").select("start").toPandas()["start"]  # as many rows as ``terms`` allows
    if not len(start):
        raise ValueError("no terms to learn from")
    width = len(start.iloc[0])
    model = Joint(np.array(start.tolist(), dtype=float), tuple(np.zeros((width + 1, c)) for c in classes))
    if model.flat().size > MODEL_SIZE:
        raise ValueError("the model is too large to be sent: fewer terms or a smaller width")
    n = {r.task: r.n for r in rows.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = (1.0 / max(1, n.get(0, 0)), aux_share / max(1, n.get(1, 0)))
    table = rows.select("idx", "weight", F.col("task").cast("int").alias("task"), F.col("label").cast("int").alias("label"))
    told = []
    for _ in range(steps):
        sent = spark.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            total, loss = np.zeros(sent.value.flat().size), np.zeros(2)
            for batch in batches:
                task, label = batch.column("task").to_numpy(), batch.column("label").to_numpy()
                g, part = gradient(sent.value, *cells(batch), task, label, scale)
                total += g
                loss += part
            whole = np.concatenate([loss, total])
            at = range(0, len(whole), GRADIENT_BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(at)), pa.int32()),
                 pa.array([whole[i:i + GRADIENT_BLOCK].tobytes() for i in at], pa.binary())], names=["block", "part"])

        def added(t: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(b) for b in t["part"]], axis=0)
            return pd.DataFrame({"block": t["block"].iloc[:1], "part": [total.tobytes()]})

        blocks = table.mapInArrow(run, "block int, part binary").groupBy("block").applyInPandas(
            added, "block int, part binary").collect()  # one gradient
        whole = np.concatenate([np.frombuffer(b.part) for b in sorted(blocks, key=lambda b: b.block)])
        if not np.isfinite(whole).all():
            raise ValueError(f"the fit diverges at rate {rate}: take a smaller one")
        told.append(tuple(float(x / max(1, n.get(t, 0))) for t, x in enumerate(whole[:2])))
        model = model.like(model.flat() - rate * whole[2:])
        sent.unpersist()
    return model, told


def score(model: Joint, rows: DataFrame) -> DataFrame:
    """``rows`` with the logits of the head that their task asks for."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select("*", F.lit(None).cast("array<double>").alias("logits")).schema

    def run(batches):
        for batch in batches:
            task = batch.column("task").to_numpy()
            hidden = sent.value.hidden(*cells(batch), len(task))
            by = [(hidden @ h).tolist() for h in sent.value.heads]
            logits = [by[t][i] for i, t in enumerate(task.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logits, pa.list_(pa.float64()))],
                                             names=[*batch.schema.names, "logits"])

    return rows.mapInArrow(run, schema)


def prepare(df: DataFrame, key: str, alpha: float = 0.5, terms: int = 1 << 16, width: int = 8,
            seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, index), both written: ``df`` (key, tokens, target_tokens, task,
    label, ...) with its indexed features, and the term index."""
    from stanceflow.operators.model import ta_features

    features = staged(ta_features(df, alpha, key), "joint-features")
    index = staged(term_index(features, terms, width, seed), "joint-terms")
    rest = df.drop("tokens", "target_tokens")
    return staged(sparse_rows(features, index, rest, key), "joint-rows"), index
