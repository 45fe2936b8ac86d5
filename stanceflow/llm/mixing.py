"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token sums are
raked: scaled to each margin's target in turn, again and again, until all
margins hold at once. A cell's ratio of raked to own tokens is the weight of
its documents. Documents are then sampled with the probability min(1, scale *
weight), where the scale is solved for so that the expected tokens are the
wanted share of all, and the draw is a hash of the document, so a repeated or
retried run draws the same.

Only the cells' sums are iterated over, never documents. Targets are shares
per category, or by default the margin's own token shares to the power
``alpha`` (1 keeps the mix, 0 makes it flat), computed from all documents.

Defined results: null categories are a category of their own (shown as empty
string, like empty ones); a category without a target keeps its own share of
the tokens, and the targets (of categories that are there) share out the rest;
one with target zero is never drawn; given targets that cannot be met together
are an error, default shares that cannot are met as nearly as raking does, with
a warning; an empty text counts as one token; repeated
rows draw alike; an empty table gives an empty frame; extra columns are kept.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stanceflow.llm.common import SPACE_CLASS, free_name, staged

ALPHA = 0.7
KEEP = 0.8
SWEEPS = 4
ROUNDS = 10
TOLERANCE = 1e-4
SEED = 17


def n_words(text: str = "text") -> Column:
    """Words of a text, at least 1: the token weight where no count is given."""
    body = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS, " "))
    return F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1


def content_form(text: str, tokens: Column) -> Column:
    """A coarse topic for corpora that have none: the form of the content."""
    lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty") \
        .when(tokens < 100, "note") \
        .when(tokens < 8 * lines, "listing") \
        .when(tokens < 1000, "article").otherwise("long")


def rake(cells: DataFrame, dims: list[str], tokens: str, targets: dict[str, dict[str, float]] | None = None,
         alpha: float = ALPHA) -> DataFrame:
    """``cells`` (one row per combination of ``dims`` with its ``tokens``) +
    ``raked``: tokens scaled until every margin has its target shares. Margins
    are matched in shape; their common total cancels out of the weights."""
    def total(shares: DataFrame, *sums: Column) -> list[float]:
        return [float(x or 0) for x in shares.agg(*sums).first()]

    goal = {}
    now = cells.withColumn("raked", F.col(tokens).cast("double"))
    for d in dims:
        own = F.sum("raked").over(Window.partitionBy(d))
        if targets and targets.get(d):
            pairs = [F.lit(x) for kv in targets[d].items() for x in (kv[0], float(kv[1]))]
            given = F.create_map(*pairs)[F.col(d)]
            per = cells.groupBy(d).agg(F.sum(tokens).alias("own")).select("own", given.alias("given"))
            whole, free, named = total(per, F.sum("own"), F.sum(F.when(F.col("given").isNull(), F.col("own"))),
                                       F.sum("given"))
            # all goals of a margin add up to 1 (if every target is zero, over the others alone)
            share = own / ((whole if named else free) or 1.0)
            scale = (1 - free / whole) / named if named else 0.0
            now = now.withColumn(f"goal_{d}", F.coalesce(given * scale, share))
        else:
            # beside given targets on the same total as they are
            per = cells.groupBy(d).agg(F.pow(F.sum(tokens), F.lit(alpha)).alias("goal"))
            whole = total(per, F.sum("goal"))[0] or 1.0 if targets else 1.0
            now = now.withColumn(f"goal_{d}", F.pow(own, F.lit(alpha)) / whole)
        goal[d] = f"goal_{d}"
    now = staged(now, "cells")
    for _ in range(ROUNDS):
        for _ in range(SWEEPS):
            for d in dims:
                # sums over cells, not documents
                whole = F.sum("raked").over(Window.partitionBy(d))
                now = now.withColumn("step", F.when(F.col(goal[d]).isNull() | (whole == 0), 1.0)
                                     .otherwise(F.col(goal[d]) / whole)) \
                    .withColumn("raked", F.col("raked") * F.col("step")) \
                    .withColumn(f"step_{d}", F.col("step"))
        now = staged(now, "raked")
        # at the end a margin's steps are all alike: only the common total moves
        spread = [F.max(F.log(f"step_{d}")) - F.min(F.log(f"step_{d}")) for d in dims]
        worst = now.where(F.col("raked") > 0).agg(F.greatest(*spread, F.lit(0.0))).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    else:
        gap = f"the margins {dims} are not met together: steps still differ by a factor of {math.exp(worst):.6g}"
        if targets:
            raise ValueError(gap)
        warnings.warn(gap, stacklevel=2)
    return now.select(*cells.columns, "raked")


def scale_for(cells: DataFrame, tokens: str, keep: float) -> float:
    """The scale at which the sum of min(tokens, scale * raked) is ``keep``
    times all tokens (or all that can be had), on ever finer grids."""
    low, high = -60.0, 60.0
    for _ in range(4):
        grid = [low + (high - low) * i / 64 for i in range(65)]
        sums = cells.agg(F.sum(tokens), *[F.sum(F.least(F.col(tokens).cast("double"), F.col("raked") * math.exp(g)))
                                          for g in grid]).first()
        if sums[0] is None:
            return 0.0
        above = next((i for i, s in enumerate(sums[1:]) if s >= keep * sums[0]), 64)
        low, high = grid[max(0, above - 1)], grid[above]
    return math.exp(high)


def calibrate(docs: DataFrame, key: str, text: str, dims: dict[str, Column], tokens: Column, keep: float = KEEP,
              alpha: float = ALPHA, targets: dict[str, dict[str, float]] | None = None,
              seed: int = SEED) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` + the dims, tokens, weight, probability and selected, under
    names that clash with no column (returned as a dictionary)."""
    wanted = [*dims, "n_tokens", "weight", "probability", "selected"]
    names = {w: free_name(w if w not in docs.columns else f"mix_{w}", docs.columns) for w in wanted}
    axes = [names[d] for d in dims]
    marked = docs.withColumn(names["n_tokens"], tokens.cast("bigint"))
    for d, c in dims.items():
        marked = marked.withColumn(names[d], F.coalesce(c.cast("string"), F.lit("")))
    cells = marked.groupBy(*axes).agg(F.sum(names["n_tokens"]).alias("tokens"))
    named = {names[d]: t for d, t in (targets or {}).items()}
    raked = rake(staged(cells, "sums"), axes, "tokens", named, alpha)
    scale = scale_for(raked, "tokens", keep)
    cell = [free_name(f"_cell{i}", marked.columns) for i in range(len(axes))]
    table = staged(raked.select(*[F.col(a).alias(c) for a, c in zip(axes, cell, strict=True)],
                                (F.col("raked") * scale / F.col("tokens")).alias(names["weight"])), "weights")
    joined = marked
    on = [F.col(a) == F.col(c) for a, c in zip(axes, cell, strict=True)]
    joined = joined.join(table, on, "left").drop(*cell)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text)), F.lit(1 << 53)) / float(1 << 53)
    joined = joined.withColumn(names["probability"], F.least(F.lit(1.0), F.col(names["weight"]))) \
        .withColumn(names["selected"], draw < F.col(names["probability"]))
    return joined, names


def document_dims(docs: DataFrame, text: str = "text") -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": content_form(text, n_words(text))}


def digest(docs: DataFrame) -> DataFrame:
    """Per document: its cell, tokens, calibrated weight and probability, and
    whether it is drawn."""
    out, names = calibrate(docs.select("doc_id", "text", "source", "lang"), "doc_id", "text", document_dims(docs),
                           n_words())
    return out.select("doc_id", *[F.col(names[n]).alias(n) for n in
                                  ("source", "lang", "topic", "n_tokens", "weight", "probability", "selected")])


def sampled(docs: DataFrame, keep: float = KEEP, alpha: float = ALPHA) -> DataFrame:
    """The drawn rows of ``docs``."""
    out, names = calibrate(docs, "doc_id", "text", document_dims(docs), n_words(), keep, alpha)
    return out.where(names["selected"]).select(*docs.columns)
