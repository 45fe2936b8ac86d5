"""Connected components of an edge table by alternating star contractions.

Each round makes every node's larger neighbours point to its smallest
neighbour, then every node's smaller neighbours likewise; the number of rounds
grows with the logarithm of the longest chain. Per round, nodes get their
minimum by an aggregation that combines on the map side and the edges meet
those minima in a plain join, so a hub with very many edges is an aggregate or
a splittable join key, never one task's group. Every round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceflow.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. ``edges``: (a, b) with a > b, distinct."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        joined = both.where(F.col("b") > F.col("a")).join(least, "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """``edges``: (a, b) bigint, any order, repeats and loops allowed. Returns
    (node, root) for every node that has an edge to another one; the root is
    the smallest node of the component (itself included as a row)."""
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where(F.col("a") > F.col("b")).distinct(), label)
    mark = _mark(now)
    while True:
        now = staged(_star(_star(now, large=True), large=False), label)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum over them (one row)."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
