"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits and mapped to the vector of
its segments' bit counts. The Manhattan distance of two such vectors is a lower
bound of the number of differing bits, so fingerprints at 3 bits or fewer have
vectors at 3 or less, and then one half of the vector (16 coordinates) differs
by at most 1. Range join on that grid: a cell is one half's exact counts; every
fingerprint is entered in its own two cells and looks into its own cells and
those one step up in one coordinate (the step down is the other one's look).
What meets passes the Manhattan bound over the whole vector and then the exact
bit count.

The counts of all segments sit in one 64-bit integer (two bits each), so the
embedding, the cells and both tests are integer expressions.

Exact copies share a fingerprint and are one node throughout. Cells with more
than ``CROWD`` fingerprints (large groups of near copies) are cut into blocks;
pairs of blocks are compared in tasks of bounded size that return a spanning
forest of the links they find instead of all links, which leaves the components
as they are.

Defined results: null texts count as empty; texts without words have
fingerprint zero and link like any other; texts under the shingle length hash
their whole word sequence; repeated rows are rows of their own; an empty table
gives an empty frame; extra columns are ignored (kept by ``one_per_group``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceflow.llm.bpe import slices
from stanceflow.llm.common import LOWER_ASCII, free_name, release_memory, staged
from stanceflow.llm.components import components

SEED = 42
#: Most fingerprints of a cell that are joined pair by pair.
CROWD = 256
#: Fingerprints in a block of a crowded cell.
BLOCK = 4096

LOW_BITS = 0x5555555555555555


def fingerprint(text: str, shingle: int) -> int:
    words = text.encode().translate(LOWER_ASCII).split()
    if not words:
        return 0
    runs = zip(*[words[i:] for i in range(shingle)]) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b" ".join(r), SEED) for r in runs], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                 shingle: int = 3) -> DataFrame:
    """``keep`` columns + fp (the 64 bits as a bigint)."""
    out = free_name("fp", keep)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.LongType())])
    n, sent = len(keep), [*keep] if text in keep else [*keep, text]
    at = sent.index(text)

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t, shingle) for _, texts in slices(batch.column(at)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(prints, pa.int64())],
                                             names=[*batch.schema.names[:n], out])
        release_memory()

    return docs.select(*sent).mapInArrow(run, schema)


def counts(fp: Column) -> Column:
    """The bit counts (0 to 2) of all two-bit segments, two bits each."""
    other, low = F.shiftrightunsigned(fp, 1), F.lit(LOW_BITS)
    return F.shiftleft(fp.bitwiseAND(other).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseXOR(other).bitwiseAND(low))


def half(c: Column, h: int) -> Column:
    return F.shiftrightunsigned(c, 32) if h else c.bitwiseAND(F.lit(0xFFFFFFFF))


def manhattan(a: Column, b: Column) -> Column:
    """Sum over segments of |a - b|: per segment, counts in {0, 1, 2} differ by
    1 or 2; as unary codes (0: 00, 1: 01, 2: 11) that is a bit count."""
    def unary(c):
        return c.bitwiseOR(F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(LOW_BITS)))
    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def cells(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own, looks): rows (h, cell, fp) for the cells a fingerprint is in, and
    for those it looks into."""
    c = counts(F.col("fp"))
    own = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(h).alias("h"), half(c, h).alias("cell")) for h in (0, 1)])).alias("at")) \
        .select(F.col("at.h").alias("h"), F.col("at.cell").alias("cell"), "fp")
    return own, looked_into(own)


def looked_into(rows: DataFrame) -> DataFrame:
    """Rows (h, cell, ...) once for each cell that they look into: their own
    (``same``) and those one step up."""
    steps = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << (2 * i)) for i in range(16)])
    rest = [c for c in rows.columns if c not in ("h", "cell")]
    return rows.select("*", F.explode(steps).alias("step")) \
        .where((F.col("step") == 0) | (F.col("cell").bitwiseAND(F.col("step") * 2) == 0)) \
        .select("h", (F.col("cell") + F.col("step")).alias("cell"), *rest, (F.col("step") == 0).alias("same"))


def _part(ways: str) -> Column:
    """Number of a fingerprint's block out of ``ways``."""
    return F.pmod(F.xxhash64("fp"), F.col(ways)).cast("int")


def links(prints: DataFrame, bits: int = 3, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) at ``bits``
    or fewer differing bits: all of them in ordinary cells, a spanning forest
    per pair of blocks in crowded ones."""
    if bits > 3:
        raise ValueError("one half within one step is proven for up to 3 bits")
    own, looks = cells(prints)
    sizes = staged(own.groupBy("h", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    crowded = sizes.where(F.col("n") > crowd)
    mine = own.join(crowded, ["h", "cell"], "left_anti").withColumnRenamed("fp", "b")
    a, b = F.col("a"), F.col("b")
    near = (manhattan(counts(a), counts(b)) <= bits) & (F.bit_count(a.bitwiseXOR(b)) <= bits)
    la, mb = looks.withColumnRenamed("fp", "a").alias("x"), mine.alias("y")
    plain = la.join(mb, (F.col("x.h") == F.col("y.h")) & (F.col("x.cell") == F.col("y.cell"))
                    & (~F.col("same") | (a < b)) & near).select("a", "b")
    # crowded cells: blocks of members against blocks of lookers, each side cut
    # by its own number; a cell's lookers are the members of the cells around it
    seen = looked_into(sizes).groupBy("h", "cell").agg(F.sum("n").alias("m"))
    keyed = staged(crowded.join(seen, ["h", "cell"]).select(
        "h", "cell", *[F.ceil(F.col(c) / F.lit(block)).cast("int").alias(w) for c, w in (("n", "rows"), ("m", "cols"))]),
        "crowded")
    members = own.join(keyed, ["h", "cell"]).select("h", "cell", "fp", _part("rows").alias("i"), F.explode(
        F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(True).alias("member"))
    lookers = looks.join(keyed, ["h", "cell"]).select("h", "cell", "fp", F.explode(
        F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), _part("cols").alias("j"), F.lit(False).alias("member"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    dense = members.unionByName(lookers).groupBy("h", "cell", "i", "j").applyInArrow(
        lambda t: forest(t, bits), schema)
    return plain.unionByName(dense)


def forest(table: pa.Table, bits: int) -> pa.Table:
    """A spanning forest of the links between the members and the lookers of
    one pair of blocks (at most a few thousand each)."""
    role = table["member"].to_numpy()
    fps = table["fp"].to_numpy()
    left, right = np.unique(fps[role]), np.unique(fps[~role])
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    out = []
    for x in left.tolist():
        # viewed as unsigned: numpy counts the bits of an absolute value
        for y in right[np.bitwise_count((right ^ x).view(np.uint64)) <= bits].tolist():
            p, q = find(x), find(y)
            if p != q:
                parent[p] = q
                out.append((x, y))
    return pa.table({"a": pa.array([e[0] for e in out], pa.int64()), "b": pa.array([e[1] for e in out], pa.int64())})


def _named(docs: DataFrame, key: str, text: str, shingle: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_key, fp), and (fp, first, root): each fingerprint's smallest
    key and its component."""
    prints = staged(fingerprints(docs, (key,), text, shingle).withColumnRenamed(key, "doc_key"), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_key").alias("first"))
    found = components(links(nodes.select("fp"), bits), "simhash").withColumnRenamed("node", "fp")
    return prints, staged(nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "nodes")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """Per row: key, fp and component_id (smallest key reachable over links)."""
    prints, first = _named(docs, key, text, shingle, bits)
    least = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = first.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("doc_key").alias(key), "fp", "component_id")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                  bits: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the
    smallest key (of several such rows, the smallest fingerprint's; of equal
    ones, any). A row goes only if the kept row is in its own group, also where
    rows with unrelated texts share a key. Rows without a key stay.

    Rows meet the list of (key, fingerprint) pairs that go, or are there more
    than once, in one merge join. That list grows with the corpus, so it is
    broadcast at no size; the texts are shuffled once."""
    cols = docs.columns
    print_, name, place = free_name("_fp", cols), free_name("_key", cols), free_name("_place", cols)
    prints, first = _named(docs, key, text, shingle, bits)
    kept = first.where(F.col("first").isNotNull()).groupBy("root").agg(
        F.min(F.struct(F.col("first").alias("doc_key"), "fp")).alias("kept"))
    pairs = prints.where(F.col("doc_key").isNotNull()).groupBy("doc_key", "fp").agg(F.count(F.lit(1)).alias("n")) \
        .join(first.join(kept, "root").select("fp", "kept"), "fp")
    stays = F.struct("doc_key", "fp") == F.col("kept")
    again, other = free_name("_again", cols), free_name("_marked", cols)
    marked = staged(pairs.where(~stays | (F.col("n") > 1)).select(
        F.col("doc_key").alias(name), F.col("fp").alias(other), stays.alias(again)), "marked")
    printed = fingerprints(docs.where(F.col(key).isNotNull()), tuple(cols), text, shingle)
    printed = printed.withColumnRenamed(free_name("fp", cols), print_)
    met = printed.join(marked.hint("merge"), (F.col(key) == F.col(name)) & (F.col(print_) == F.col(other)), "left")
    # the join leaves each pair's rows together and in order: no further shuffle
    left = met.withColumn(place, F.row_number().over(Window.partitionBy(key, print_).orderBy(key, print_))) \
        .where(F.col(again).isNull() | (F.col(again) & (F.col(place) == 1)))
    return left.select(*cols).unionByName(docs.where(F.col(key).isNull()))


def digest(docs: DataFrame) -> DataFrame:
    out = groups(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
