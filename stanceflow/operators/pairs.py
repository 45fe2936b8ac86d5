"""Pair encoding, target awareness and vocabulary.

The reference materialises a dense max_len x max_len matrix per row; here a
row carries its span (start, end, alpha) and cells are exploded only on
demand, bounded by the span length.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanceflow.functions.pairs import (
    MARKERS, PAD, attention_mask, encode_sequence, pad_sequence, span_end, span_start,
)


def markers(model: str) -> tuple[str, str]:
    return MARKERS.get(model, MARKERS["Bert"])


def encode_pair(df: DataFrame, tokens: str = "tokens", target_tokens: str = "target_tokens",
                model: str = "Bert", max_len: int | Column = 128, out: str = "seq") -> DataFrame:
    """E1 + E2: one sequence [CLS] text [SEP] target [SEP], truncated to max_len."""
    cls, sep = markers(model)
    return df.withColumn(out, encode_sequence(tokens, target_tokens, cls, sep, max_len))


def pad_truncate(df: DataFrame, seq: str = "seq", max_len: int = 128) -> DataFrame:
    """Padded sequence and attention mask (1 on real tokens)."""
    return (df.withColumn("input_tokens", pad_sequence(seq, max_len))
            .withColumn("attention_mask", attention_mask(seq, max_len))
            .withColumn("n_tokens", F.size(seq)))


def target_span(df: DataFrame, seq: str = "seq", model: str = "Bert") -> DataFrame:
    """Span [b+1, e) between the first and the next separator; span_end is
    null for an extra-long row (no second separator)."""
    _, sep = markers(model)
    return (df.withColumn("span_start", span_start(seq, sep))
            .withColumn("span_end", span_end(seq, sep)))


def extra_long(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows without a second separator (zero awareness matrix)."""
    return df.groupBy(*by).agg(F.count_if(F.col("span_end").isNull()).alias("n_extra_long"),
                               F.count(F.lit(1)).alias("n_rows"))


def ta_bias(df: DataFrame, alpha: float) -> DataFrame:
    """E5 in sparse form: alpha on the square block of the span."""
    width = F.coalesce(F.col("span_end") - F.col("span_start"), F.lit(0))
    return (df.withColumn("alpha", F.lit(float(alpha)))
            .withColumn("n_cells", (width * width).cast("long")))


def ta_bias_cells(df: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """E5 exploded on demand: one row (j, k, bias) per non-zero cell, bounded
    by span length squared (at most (max_len - 3)^2 per row)."""
    span = F.when(F.col("span_end") > F.col("span_start"),
                  F.sequence(F.col("span_start"), F.col("span_end") - 1))
    return (df.select(*key, "alpha", F.explode(span).alias("j"), span.alias("_s"))
            .select(*key, "j", F.explode("_s").alias("k"), F.col("alpha").alias("bias")))


# E6 ------------------------------------------------------------------------

_MASK_SPEC = re.compile(r"^\s*([0-9.]+)l_([0-9.]+)h\s*$")


def parse_mask_spec(spec: str) -> tuple[float, float]:
    m = _MASK_SPEC.match(spec)
    if not m:
        raise ValueError(f"head-mask spec must look like '0.50l_0.25h', got {spec!r}")
    return float(m.group(1)), float(m.group(2))


def head_mask_column(spec: str | None, layers: int = 12, heads: int = 12) -> Column:
    """array<struct<layer,head,on>> for one spec (no spec = every head on).
    The label is followed: 'lf l_hf h' switches on layer < lf*L and head < hf*H."""
    lf, hf = parse_mask_spec(spec) if spec else (1.0, 1.0)
    cells = []
    for layer in range(layers):
        for head in range(heads):
            on = int(layer < lf * layers - 1e-9 and head < hf * heads - 1e-9)
            cells.append(F.struct(F.lit(layer).alias("layer"), F.lit(head).alias("head"), F.lit(on).alias("on")))
    return F.array(*cells)


def head_mask(spark, spec: str | None, layers: int = 12, heads: int = 12) -> DataFrame:
    """E6 as a (layer, head, on) frame."""
    return spark.range(1).select(F.inline(head_mask_column(spec, layers, heads)))


def head_mask_bias(spans: DataFrame, specs: Sequence[str], key: Sequence[str] = ("doc_id",), layers: int = 12,
                   heads: int = 12) -> DataFrame:
    """Each row's bias mass (alpha x span cells) per (mask, layer, head): the
    head mask multiplies the target-awareness bias of every row per head. The
    grid is a generator on the row, not a join."""
    grids = F.array(*[F.struct(F.lit(s).alias("mask"), head_mask_column(s, layers, heads).alias("g"))
                      for s in specs])
    per = spans.select(*key, (F.col("alpha") * F.col("n_cells")).alias("mass"), F.inline(grids))
    return per.select(*key, "mask", "mass", F.inline("g")).select(
        *key, "mask", "layer", "head", "on", (F.col("on") * F.col("mass")).alias("bias_mass"))


def head_mask_mass(spans: DataFrame, specs: Sequence[str], key: Sequence[str] = ("doc_id",), layers: int = 12,
                   heads: int = 12) -> DataFrame:
    """``head_mask_bias`` without its cells: one row per row and mask. The heads
    that are on form a rectangle, ``layers_on`` x ``heads_on``; each carries
    ``mass``, together ``total_mass``."""
    masks = []
    for spec in specs:
        lf, hf = parse_mask_spec(spec)
        on = [sum(i < part * n - 1e-9 for i in range(n)) for part, n in ((lf, layers), (hf, heads))]
        masks.append(F.struct(F.lit(spec).alias("mask"), F.lit(on[0]).alias("layers_on"), F.lit(on[1]).alias("heads_on")))
    per = spans.select(*key, (F.col("alpha") * F.col("n_cells")).alias("mass"), F.inline(F.array(*masks)))
    return per.withColumn("total_mass", F.col("mass") * F.col("layers_on") * F.col("heads_on"))


# E8 ------------------------------------------------------------------------

def update_by_ids(df: DataFrame, updates: DataFrame, id_col: str, value_col: str,
                  order_col: str = "update_seq") -> DataFrame:
    """Replace ``value_col`` where the id matches; the first update per id
    (by ``order_col``) wins, other rows keep theirs, unknown ids are ignored."""
    first = updates.groupBy(id_col).agg(F.min_by(value_col, order_col).alias("_new"))
    return (df.join(first, id_col, "left")
            .withColumn("updated", F.col("_new").isNotNull())
            .withColumn(value_col, F.coalesce(F.col("_new"), F.col(value_col))).drop("_new"))


# E10-E12, J6, S8 -----------------------------------------------------------

def build_vocab(token_sets: Sequence[DataFrame], tokens: str = "tokens",
                specials: Sequence[str] = (PAD,)) -> DataFrame:
    """Token counts over several token sets; specials first, then by
    count desc, token asc. Output (token, count, idx)."""
    from stanceflow.operators.index import with_row_index_by

    exploded = None
    for s in token_sets:
        e = s.select(F.explode(tokens).alias("token"))
        exploded = e if exploded is None else exploded.unionByName(e)
    counts = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    sp = list(specials)
    if sp:
        counts = counts.filter(~F.col("token").isin(*sp))
    # slices: one per count, cut by the first letters of the token
    ordered = with_row_index_by(counts, [(F.col("count"), True), (F.substring("token", 1, 2), False)],
                                [(F.col("count"), True), (F.col("token"), False)], out="idx")
    ordered = ordered.withColumn("idx", F.col("idx") + F.lit(len(sp)))
    if sp:
        spec_rows = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(0).cast("long").alias("count"),
                                       F.lit(i).cast("long").alias("idx")) for i, t in enumerate(sp)])
        head = counts.sparkSession.range(1).select(F.inline(spec_rows))
        ordered = head.unionByName(ordered.select("token", "count", "idx"))
    return ordered.select("token", "count", "idx")


def read_vectors(vectors: DataFrame, limit: int = 500_000, rank: str = "rank") -> DataFrame:
    """The first ``limit`` vectors in file order (in no particular order).
    Ranks are unique; rows without one are no vectors. A large ``limit`` runs as
    a distributed selection that ends in a filter."""
    from stanceflow.operators.ordering import first_n
    return first_n(vectors.where(F.col(rank).isNotNull()), limit, [rank])


def uniform_fallback(seed: int, token: Column, dims: int, low: float = -0.25, high: float = 0.25) -> Column:
    """Repeatable uniform(low, high) per dimension from md5(seed:token:dim)."""
    def u(i):
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), token, i.cast("string")))
        frac = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        return F.lit(low) + frac * F.lit(high - low)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), u)


def embed_vocab(vocab: DataFrame, vectors: DataFrame, dims: int, seed: int = 1,
                key: str = "token", vector: str = "vector") -> DataFrame:
    """Known -> vector, <pad> -> zeros, else uniform(-0.25, 0.25).
    ``key``: the column that vocabulary and vectors share. A plain left join: Spark broadcasts the vectors only when its statistics
    say they fit under the broadcast threshold, else it shuffles both sides."""
    vec = vectors.select(key, F.col(vector).cast("array<double>").alias("_vec"))
    j = vocab.join(vec, key, "left")
    zeros = F.array_repeat(F.lit(0.0), dims)
    kind = (F.when(F.col("_vec").isNotNull(), F.lit("known"))
            .when(F.col("token") == F.lit(PAD), F.lit("pad")).otherwise(F.lit("random")))
    emb = (F.when(F.col("_vec").isNotNull(), F.col("_vec"))
           .when(F.col("token") == F.lit(PAD), zeros)
           .otherwise(uniform_fallback(seed, F.col("token"), dims)))
    return j.select(*vocab.columns, kind.alias("kind"), emb.alias("embedding"))


def vocab_coverage(embedded: DataFrame) -> DataFrame:
    """Vocabulary size and the share of tokens with a known vector."""
    return embedded.agg(F.count(F.lit(1)).alias("vocab_size"),
                        F.count_if(F.col("kind") == "known").alias("n_known"),
                        F.avg((F.col("kind") == "known").cast("double")).alias("known_share"))
