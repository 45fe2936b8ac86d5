"""Positional alignment between two frames.

Files that belong together by row position are aligned through the
distributed row index (``index.with_row_index``) and an equi-join on it;
no frame is ever pulled into one task to be zipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceflow.operators.index import with_row_index
from stanceflow.operators.ordering import indexed
from stanceflow.session import staged

#: Rows in a chunk, and chunks in a chunk of the next level.
CHUNK = 1024


def align_by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str,
                      how: str = "inner") -> DataFrame:
    """Rows of two frames paired by their position in key order (a key of any
    orderable type); the right-hand columns get an ``r_`` prefix."""
    li = indexed(left, left_order, out="idx")
    ri = indexed(right, right_order, out="idx")
    ri = ri.select("idx", *[F.col(c).alias(f"r_{c}") for c in right.columns])
    return li.join(ri, "idx", how)


def zero_shot_subset(parsed: DataFrame, reference: DataFrame, parsed_order: str, reference_order: str,
                     seen: str = "seen", keep: Sequence[str] | None = None) -> DataFrame:
    """Keep the parsed rows whose aligned reference row has ``seen = 0``,
    renumbered from 0 (``new_idx``) in their original order."""
    aligned = align_by_position(parsed, reference.select(reference_order, seen), parsed_order, reference_order)
    subset = aligned.filter(F.col(f"r_{seen}") == 0)
    cols = list(keep) if keep is not None else list(parsed.columns)
    subset = subset.select("idx", *cols)
    return with_row_index(subset, "idx", out="new_idx").drop("idx")


def alignment_audit(left: DataFrame, right: DataFrame, left_order: str, right_order: str,
                    left_text: str, right_text: str, ignore: DataFrame | None = None,
                    seen: str | None = None, expected_subset: int | None = None) -> DataFrame:
    """One-row report: equal lengths; text equal at every position outside
    the ignore list (a frame of positions ``idx``);
    and, optionally, the size of the seen = 0 subset against its expected value.
    The texts meet as SHA-256 digests, so no text is shuffled.
    ``differing_positions`` lists the positions themselves."""
    def digest(c):
        return F.sha2(F.col(c).cast("binary"), 256).alias(c)

    aligned = align_by_position(left.select(left_order, digest(left_text)),
                                right.select(right_order, digest(right_text), *([seen] if seen else [])),
                                left_order, right_order, how="full_outer")
    if ignore is not None:
        flags = ignore.select("idx").distinct().withColumn("_ign", F.lit(True))
        aligned = aligned.join(flags, "idx", "left")
    else:
        aligned = aligned.withColumn("_ign", F.lit(False))
    ign = F.coalesce(F.col("_ign"), F.lit(False))
    mism = ~F.col(left_text).eqNullSafe(F.col(f"r_{right_text}"))
    agg = [F.count(F.col(left_order)).alias("n_left"), F.count(F.col(f"r_{right_order}")).alias("n_right"),
           F.count_if(~ign).alias("n_compared"), F.count_if(ign).alias("n_ignored"),
           F.count_if(~ign & mism).alias("n_mismatch")]
    if seen:
        agg.append(F.count_if(F.col(f"r_{seen}") == 0).alias("n_subset"))
    rep = aligned.agg(*agg)
    rep = rep.withColumn("length_ok", F.col("n_left") == F.col("n_right")).withColumn(
        "text_ok", F.col("n_mismatch") == 0)
    if seen and expected_subset is not None:
        rep = rep.withColumn("subset_ok", F.col("n_subset") == F.lit(expected_subset))
    return rep


def _levels(rows: DataFrame, levels: int, chunk: int) -> list[DataFrame]:
    """(c, h) per level: chunks of ``chunk`` members of the level below, by an
    order-free 128-bit digest in which every member counts with its place, and
    the number of members. Map-side sums do nearly all of it: rows of a chunk
    lie together."""
    out, at, name = [], rows, "idx"
    for _ in range(levels):
        cells = [F.col(c) for c in at.columns if c != name]
        at = at.groupBy(F.floor(F.col(name) / chunk).alias("c")).agg(
            F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(name, *cells)).alias("a"),
                     F.bit_xor(F.xxhash64(F.lit(1), *cells, name)).alias("b")).alias("h"))
        out.append(at)
        name = "c"
    return out


def differing_chunks(left: DataFrame, right: DataFrame, levels: int, chunk: int) -> DataFrame:
    """Numbers ``c`` of the chunks of rows (idx, ...) whose digests differ. A
    level is only compared inside the differing chunks of the level above."""
    found = None
    for mine, other in reversed(list(zip(_levels(left, levels, chunk), _levels(right, levels, chunk), strict=True))):
        if found is not None:
            above = found.select(F.col("c").alias("_up"))
            mine, other = (f.withColumn("_up", F.floor(F.col("c") / chunk)).join(above, "_up", "left_semi").drop("_up")
                           for f in (mine, other))
        both = mine.join(other.select("c", F.col("h").alias("g")), "c", "full_outer")
        found = both.where(~F.col("h").eqNullSafe(F.col("g"))).select("c")
    return found


def differing_positions(left: DataFrame, right: DataFrame, left_order: str, right_order: str, left_text: str,
                        right_text: str, ignore: DataFrame | None = None, levels: int = 2,
                        chunk: int = CHUNK) -> DataFrame:
    """J3 in detail: (idx, left_key, right_key, kind) for each position, outside
    the ignore list, whose texts differ (kind ``text``) or that one side lacks
    (``left only``, ``right only``). Two null texts are equal.

    Digests of the rows are written once; digests of chunks and of chunks of
    chunks say where to look, so equal stretches never meet row by row. A row
    that is missing in the middle moves all later ones: those then differ."""
    def digested(df, order, text):
        rows = indexed(df.select(F.col(order).alias("key"), F.sha2(F.col(text).cast("binary"), 256).alias("t")), "key")
        return staged(rows.select(F.col("idx").cast("long").alias("idx"), "key", "t"), "audit")

    li, ri = digested(left, left_order, left_text), digested(right, right_order, right_text)
    where = differing_chunks(li.select("idx", "t"), ri.select("idx", "t"), levels, chunk)
    near = [f.withColumn("c", F.floor(F.col("idx") / chunk)).join(where, "c", "left_semi").drop("c") for f in (li, ri)]
    met = near[0].select("idx", F.col("key").alias("left_key"), F.col("t").alias("_l"), F.lit(True).alias("_in_l")).join(
        near[1].select("idx", F.col("key").alias("right_key"), F.col("t").alias("_r"), F.lit(True).alias("_in_r")),
        "idx", "full_outer")
    kind = F.when(F.col("_in_r").isNull(), F.lit("left only")).when(F.col("_in_l").isNull(), F.lit("right only")) \
        .when(~F.col("_l").eqNullSafe(F.col("_r")), F.lit("text"))
    out = met.withColumn("kind", kind).where(F.col("kind").isNotNull())
    if ignore is not None:
        out = out.join(ignore.select("idx"), "idx", "left_anti")
    return out.select("idx", "left_key", "right_key", "kind")
