"""Keyword flags for long keyword lists (T4).

A list of thousands of substrings is looked for in one pass over each text: the
hashes of all windows of 1, 2, 4 and 8 characters come from doubling (a window
of 2g is two of g), and each keyword waits under the hash of its first 8, 4, 2
or 1 characters. Places whose hash is among them are compared in full, so the
result is that of one ``contains`` per keyword, at a cost that hardly depends
on their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most characters of keywords that are sent to every task.
BROADCAST_CHARS = 32 << 20

#: Characters of text hashed at a time (a longer text is a run of its own).
RUN_CHARS = 1 << 20

FILTER_BITS = 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)
STEPS = {2: np.uint64(0xC2B2AE3D27D4EB4F), 4: np.uint64(0x165667B19E3779F9), 8: np.uint64(0xD6E8FEB86659FD93)}


def windows(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the windows of 1, 2, 4 and 8 characters at every place; the
    windows at the end take in zeros."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * SPREAD
    out = {1: h}
    for g, step in STEPS.items():
        behind = np.zeros_like(h)
        behind[:max(0, len(h) - g // 2)] = h[g // 2:]
        h = (h * step) ^ (behind + (h >> np.uint64(29)))
        out[g] = h
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Keywords:
    """A list of substrings; an empty one is in every text, null ones count for nothing."""

    def __init__(self, words: list[str]):
        words = sorted({w for w in words if w is not None})
        self.always = bool(words) and words[0] == ""
        self.under: dict[int, dict[int, list[str]]] = {}
        for w in words:
            if w:
                g = max(g for g in (1, 2, 4, 8) if g <= len(w))
                head = int(windows(codes_of(w[:g]))[g][0])
                self.under.setdefault(g, {}).setdefault(head, []).append(w)
        self.filters = {}
        for g, heads in self.under.items():
            marks = np.zeros(1 << FILTER_BITS, dtype=bool)
            marks[np.array(list(heads), dtype=np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
            self.filters[g] = marks

    def found_in(self, texts: list[str]) -> np.ndarray:
        """For each text, whether it holds a keyword."""
        found = np.full(len(texts), self.always)
        if self.always or not self.under:
            return found
        ends = np.cumsum([len(t) for t in texts])
        hashes = windows(codes_of("".join(texts)))
        for g, heads in self.under.items():
            h = hashes[g]
            places = np.flatnonzero(self.filters[g][h >> np.uint64(64 - FILTER_BITS)])
            owners = np.searchsorted(ends, places, side="right")
            for place, owner, head in zip(places.tolist(), owners.tolist(), h[places].tolist(), strict=True):
                words = heads.get(head)
                if words is not None and not found[owner]:
                    text = texts[owner]
                    at = place - int(ends[owner]) + len(text)
                    if any(text.startswith(w, at) for w in words):
                        found[owner] = True
        return found


def runs(texts: list[str | None]):
    """(first, end) of runs of about RUN_CHARS characters."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or "") > RUN_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def explicit_flag_many(df: DataFrame, keywords: DataFrame, text: str = "text", target: str = "target",
                       out: str = "explicit", most: int = BROADCAST_CHARS) -> DataFrame:
    """T4 for long lists: ``df`` with ``out``, true for rows whose text holds a
    keyword of their target. ``keywords``: (target, keywords array<string>);
    several rows of one target count together. A null text gives null; a row
    whose target has no keywords raises an error when it is met.

    The lists are measured by one job when this is called. Up to ``most``
    characters they are sent to the tasks; longer ones meet the texts in
    ``perturb.explicit_flag``'s join."""
    lists = keywords.select(F.col("target").alias("t"), F.explode_outer("keywords").alias("k")).groupBy("t").agg(
        F.collect_set("k").alias("ks"))
    size = keywords.select(F.sum(F.aggregate("keywords", F.lit(0).cast("bigint"),
                                             lambda a, k: a + F.coalesce(F.length(k), F.lit(0)) + 1))).first()[0]
    if (size or 0) > most:
        from stanceflow.operators.perturb import explicit_flag

        one = lists.select(F.col("t").alias("target"), F.col("ks").alias("keywords"))
        return explicit_flag(df, one, text, target).withColumnRenamed("explicit", out)
    sent = df.sparkSession.sparkContext.broadcast({r.t: list(r.ks) for r in lists.where("t is not null").collect()})
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType())])
    at_text, at_target = df.columns.index(text), df.columns.index(target)

    def run(batches):
        made: dict[str, Keywords] = {}
        for batch in batches:
            texts, targets = batch.column(at_text).to_pylist(), batch.column(at_target).to_pylist()
            flags = np.zeros(len(texts), dtype=object)
            for t in set(targets):
                if t not in sent.value:
                    raise ValueError(f"no keywords for target {t}")
                if t not in made:
                    made[t] = Keywords(sent.value[t])
                rows = [i for i, x in enumerate(targets) if x == t]
                own = [texts[i] for i in rows]
                for a, b in runs(own):
                    found = made[t].found_in([x or "" for x in own[a:b]])
                    for i, x, hit in zip(rows[a:b], own[a:b], found.tolist(), strict=True):
                        flags[i] = None if x is None else hit
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags.tolist(), pa.bool_())],
                                             names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
