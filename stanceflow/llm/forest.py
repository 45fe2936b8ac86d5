"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a string of bits, the signs of its products with
the tree's own random orthogonal directions, and keeps its strings in sorted
arrays, where the strings that share a prefix stand together. A query first
goes down all trees: it finds how many strings share each prefix length with
its own. Then it comes up in all trees together: the length falls, the same in
every tree, until the trees hold at least ``share`` times as many matches as
there are vectors. What matches at that length is scored exactly.

The vectors are cut into pieces of at most about ``PIECE`` by a hash of the
vector's key, and the queries likewise into blocks of about ``BLOCK``; a piece
and a block make one group, which holds the arrays of all trees over one copy
of the vectors and gives at most ``k`` + 1 candidates per query, so a task's
size does not grow with the table. Smaller tables are cut into up to ``SPREAD``
pieces of ``LEAST`` or more, to be dealt to several tasks; results do not depend
on the cut. Every query meets every piece: what is shuffled grows with queries
times vectors (README). Equal vectors are one entry with their smallest keys,
however many there are.

``share`` trades work for recall and depends on how clustered the vectors are,
not on their number. The default is for nearly unstructured vectors, where the
20th neighbour is some 65 degrees away: there prefix matching has to score
more pairs than there are vectors, over all trees, to be sure of a recall of 0.9
(README: measured).
On clustered vectors a small fraction does.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; each length is searched among its own vectors, as a
forest of its own; repeated vectors tie, smaller keys first; with fewer candidates than asked, all of them; repeated
keys count as separate entries of their vectors; an empty table gives an empty
frame; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanceflow.llm.common import staged

TREES = 24
BITS = 24
SHARE = 1.5
PIECE = 65_536
#: Queries in a block; as large as a piece, the copies of both sides are fewest.
BLOCK = 65_536
SPREAD = 16
LEAST = 4_096
#: Queries whose matches in all trees are merged at a time.
CHUNK = 1_024
SEED = 11


def directions(tree: int, size: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """``bits`` random directions (columns), orthogonal as far as they can be."""
    rng = np.random.default_rng([seed, tree])
    # no square of a length far over the number of bits
    wide = size if size <= 1024 else bits
    blocks = [np.linalg.qr(rng.normal(size=(size, wide)))[0] for _ in range(-(-bits // size))]
    return np.hstack(blocks)[:, :bits]


def hash_strings(x: np.ndarray, trees: int, bits: int = BITS) -> np.ndarray:
    """(rows, trees) bit strings as integers, first bit highest."""
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)
    return np.stack([(x @ directions(t, x.shape[1], bits) > 0) @ weights for t in range(trees)], axis=1) \
        if len(x) else np.zeros((0, trees), np.int64)


def unpack(column) -> np.ndarray:
    """Vectors as rows of doubles from binary values of equal length."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype="<f8").reshape(len(values), -1) if values else np.zeros((0, 1))


def by_size(batch: pa.RecordBatch):
    """(size, rows) of each vector length in a batch (column ``size``)."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        yield size, batch.filter(pa.array(sizes == size))


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_key, vec): usable vectors, components as little-endian doubles."""
    def run(batches):
        for batch in batches:
            keys, out = [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                if np.isfinite(x).all() and x.any():
                    keys.append(k)
                    out.append((x + 0.0).tobytes())  # no negative zeros: equal vectors, equal bytes
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())],
                                             names=["vec_key", "vec"])

    return vectors.select(F.col(key).cast("long"), vector).mapInArrow(run, "vec_key long, vec binary")


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20,
           trees: int = TREES, bits: int = BITS, share: float = SHARE, piece: int = PIECE,
           block: int = BLOCK) -> DataFrame:
    """For each row whose key is divisible by ``every``: query_id, rank,
    vec_id, score of the ``k`` largest inner products found."""
    rows = staged(valid(vectors, key, vector), "vectors")
    query = F.col("vec_key") % every == 0
    classes = rows.groupBy("vec").agg(F.min("vec_key").alias("cid"), F.max(query).alias("asks")) \
        .withColumn("size", (F.octet_length("vec") / 8).cast("int"))

    kind = "<i4" if bits < 32 else "<i8"

    def add_strings(batches):
        for whole in batches:
            for _, batch in by_size(whole):
                strings = hash_strings(unpack(batch.column(0)), trees, bits).astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([r.tobytes() for r in strings], pa.binary())],
                    names=[*batch.schema.names, "strings"])

    base = staged(classes.mapInArrow(add_strings, "vec binary, cid long, asks boolean, size int, strings binary"),
                  "forest")
    # one row per vector length: few, as so many different lengths take that much data
    pieces, blocks, least = {}, {}, {}
    for size, n, n_asks in base.groupBy("size").agg(F.count(F.lit(1)), F.count_if("asks")).collect():
        pieces[size] = max(-(-n // piece), min(SPREAD, -(-n // LEAST)))
        blocks[size] = -(-n_asks // block)
        least[size] = max(int(np.ceil(share * n)), trees * (k + 1))

    def slot(size, piece_, block_, n):
        """Columns of ``group``: numbers or arrays of them."""
        return [pa.array(np.broadcast_to(np.asarray(x, np.int32), n)) for x in (size, piece_, block_)]

    def strings_of(column) -> np.ndarray:
        """(rows, trees) from the binary column."""
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, trees).astype(np.int64)

    def entries(batches):
        """Index: one row per vector and block of queries."""
        for whole in batches:
            for size, batch in by_size(whole):
                place = batch.column("hash").to_numpy() % pieces[size]
                for b in range(blocks[size]):
                    yield pa.RecordBatch.from_arrays(
                        [*slot(size, place, b, len(place)), *[batch.column(c) for c in batch.schema.names[2:]]],
                        names=[*group, *batch.schema.names[2:]])

    def asked(batches):
        """Queries: one row per vector and piece."""
        for whole in batches:
            for size, batch in by_size(whole):
                place = batch.column("hash").to_numpy() % blocks[size]
                for p in range(pieces[size]):
                    yield pa.RecordBatch.from_arrays(
                        [*slot(size, p, place, len(place)), *[batch.column(c) for c in batch.schema.names[2:]]],
                        names=[*group, *batch.schema.names[2:]])

    group = ["size", "piece", "block"]
    slots = "size int, piece int, block int, strings binary, cid long"
    keyed = base.select("size", F.xxhash64("cid").alias("hash"), "strings", "cid", "vec")
    # another hash than that of the pieces
    asks = base.where("asks").select("size", F.xxhash64("cid", F.lit(SEED)).alias("hash"), "strings", "cid")

    def bounds(own: np.ndarray, strings: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings with the first ``level`` bits of ``own`` stand."""
        rest = bits - np.asarray(level)
        low = (own >> rest) << rest
        return np.searchsorted(strings, low), np.searchsorted(strings, low + (1 << rest))

    def descend(queries: pa.Table, entries: pa.Table) -> pa.Table:
        counts = np.zeros((bits + 1, queries.num_rows), np.int64)
        if queries.num_rows and entries.num_rows:
            own, all_strings = strings_of(queries["strings"]), strings_of(entries["strings"])
            for t in range(trees):
                strings = np.sort(all_strings[:, t])
                for level in range(bits + 1):
                    low, high = bounds(own[:, t], strings, level)
                    counts[level] += high - low
        out = {"cid": queries["cid"], "least": pa.array([least[x] for x in queries["size"].to_pylist()], pa.int64())}
        return pa.table(out | {f"n{level}": pa.array(c) for level, c in enumerate(counts)})

    levels = [f"n{level}" for level in range(bits + 1)]
    matches = asks.mapInArrow(asked, slots).groupBy(*group).cogroup(
        keyed.drop("vec").mapInArrow(entries, slots).groupBy(*group)).applyInArrow(
            descend, "cid long, least long, " + ", ".join(f"{c} long" for c in levels))
    total = matches.groupBy("cid").agg(F.max("least").alias("least"), *[F.sum(c).alias(c) for c in levels])
    # matches only grow on the way up: as many levels as still have enough
    enough = sum((F.when(F.col(c) >= F.col("least"), 1).otherwise(0) for c in levels[1:]), F.lit(0))
    chosen = total.select("cid", enough.cast("int").alias("level"))

    def top(scores, cids):
        """(row, place) of the ``k`` + 1 best of each row; ties at the edge: of
        all that reach the last kept score, the smallest keys."""
        keep = min(k + 1, scores.shape[1])
        edge = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
        r, c = np.nonzero(scores >= edge[:, None])
        if len(r) > keep * len(scores):
            by = np.lexsort((cids[c], -scores[r, c], r))
            r, c = r[by], c[by]
            good = np.arange(len(r)) - np.searchsorted(r, r) < keep
            r, c = r[good], c[good]
        return r, c

    def merged(rows_, cids, scores):
        """The best ``k`` + 1 different partners of each row over all trees."""
        by = np.lexsort((-scores, cids, rows_))
        rows_, cids, scores = rows_[by], cids[by], scores[by]
        new = np.ones(len(rows_), bool)
        new[1:] = (rows_[1:] != rows_[:-1]) | (cids[1:] != cids[:-1])
        rows_, cids, scores = rows_[new], cids[new], scores[new]
        by = np.lexsort((cids, -scores, rows_))
        rows_, cids, scores = rows_[by], cids[by], scores[by]
        good = np.arange(len(rows_)) - np.searchsorted(rows_, rows_) <= k
        return rows_[good], cids[good], scores[good]

    def ascend(queries: pa.Table, entries: pa.Table) -> pa.Table:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and entries.num_rows:
            x, cids, strings = unpack(entries["vec"]), entries["cid"].to_numpy(), strings_of(entries["strings"])
            q, own = unpack(queries["vec"]), strings_of(queries["strings"])
            level, qids = queries["level"].to_numpy().astype(np.int64), queries["cid"].to_numpy()
            orders = np.argsort(strings, axis=0, kind="stable")
            arrays = np.take_along_axis(strings, orders, axis=0)
            for start in range(0, len(q), CHUNK):
                chunk, found = slice(start, start + CHUNK), []
                for t in range(trees):
                    low, high = bounds(own[chunk, t], arrays[:, t], level[chunk])
                    # queries with one prefix share one stretch of the array
                    for a, b in {*zip(low.tolist(), high.tolist(), strict=True)}:
                        if b == a:
                            continue
                        which, at = np.nonzero((low == a) & (high == b))[0], orders[a:b, t]
                        near = x[at]
                        for some in np.array_split(which, -(-len(which) // 256)):
                            scores = q[chunk][some] @ near.T
                            r, c = top(scores, cids[at])
                            found.append((some[r], cids[at][c], scores[r, c]))
                if found:
                    r, c, scores = merged(*map(np.concatenate, zip(*found, strict=True)))
                    best.append((qids[chunk][r], c, scores))
        return pa.table(dict(zip(("qid", "cid", "score"), map(np.concatenate, zip(*best, strict=True)), strict=True)))

    ready = asks.join(base.select("cid", "vec"), "cid").join(chosen, "cid") \
        .select("size", "hash", "strings", "cid", "vec", "level")
    near = ready.mapInArrow(asked, f"{slots}, vec binary, level int") \
        .groupBy(*group).cogroup(keyed.mapInArrow(entries, f"{slots}, vec binary").groupBy(*group)) \
        .applyInArrow(ascend, "qid long, cid long, score double") \
        .groupBy("qid", "cid").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    best = near.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k + 1).drop("r")
    # the smallest keys of each vector; the limit is applied before the shuffle
    by_class = Window.partitionBy("vec").orderBy("vec_key")
    members = rows.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1) \
        .join(base.select("vec", "cid"), "vec").select("cid", "vec_key")
    by_member = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_key")
    lists = best.join(members, "cid").withColumn("r", F.row_number().over(by_member)).where(F.col("r") <= k + 1) \
        .groupBy("qid").agg(F.collect_list(F.struct("r", "vec_key", "score")).alias("found"))  # k + 1 at most
    askers = rows.where(query).join(base.where("asks").select("vec", F.col("cid").alias("qid")), "vec") \
        .select("qid", F.col("vec_key").alias("query_id"))
    own = F.filter(F.sort_array("found"), lambda s: s["vec_key"] != F.col("query_id"))
    return askers.join(lists, "qid").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("pos", "s")) \
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("s.vec_key").alias("vec_id"),
                F.col("s.score").alias("score"))
