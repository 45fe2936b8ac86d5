"""Registered pair-encoding, target-awareness and vocabulary queries
(E1-E12, J6, S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanceflow.functions.text import clean_aspect_tokens
from stanceflow.operators import pairs as E
from stanceflow.operators.index import assign_batches
from stanceflow.plans.registry import query, rounded
from stanceflow.plans.sqlviews import STANCE_VIEW, lit, sql_clean_aspect, with_views
from stanceflow.plans.views import stance_view, table
from stanceflow.sources.readers import split_by_key

ALPHA = 0.5
# The head-mask labels of the sweep scripts.
MASK_SPECS = ("0.50l_0.25h", "0.50l_0.50h", "0.50l_1.00h", "1.00l_0.25h", "1.00l_0.50h")
VOCAB_VECTORS = 500_000  # the first-N read of the vector file (reference default)


def token_pairs(spark, sf):
    sv = stance_view(spark, sf)
    return sv.select("doc_id", "target", clean_aspect_tokens("text").alias("tokens"),
                     clean_aspect_tokens("target_text").alias("target_tokens"))


def encoded(spark, sf, max_len):
    return E.target_span(E.encode_pair(token_pairs(spark, sf), max_len=max_len))


TOKS = with_views(STANCE_VIEW, f"""pv AS (
  SELECT doc_id, target, {sql_clean_aspect('text')} AS toks, {sql_clean_aspect('target_text')} AS tgt
  FROM stance_view)""")


def seq_sql(max_len: int, cls: str = "[CLS]", sep: str = "[SEP]") -> str:
    return (f"list_concat(list_concat([{lit(cls)}], (list_concat(list_concat(toks, [{lit(sep)}]), tgt))"
            f"[1:{max_len - 2}]), [{lit(sep)}])")


def spans_sql(lens=(128, 8192)) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, target, {n} AS max_len, {seq_sql(n)} AS seq FROM pv" for n in lens)
    return f""", sq AS ({parts}),
b AS (SELECT *, list_position(seq, '[SEP]') AS b1 FROM sq),
sp AS (SELECT doc_id, target, max_len, seq, CAST(b1 AS INTEGER) AS span_start,
              CAST(b1 + list_position(seq[b1 + 1:], '[SEP]') - 1 AS INTEGER) AS span_end FROM b)"""


@query("encode_pair", TOKS + f"""
SELECT doc_id, array_to_string({seq_sql(128)}, ' ') AS seq, CAST(len({seq_sql(128)}) AS BIGINT) AS n_tokens
FROM pv""")
def q_encode_pair(spark, sf):
    df = E.encode_pair(token_pairs(spark, sf), max_len=128)
    return df.select("doc_id", F.array_join("seq", " ").alias("seq"), F.size("seq").cast("long").alias("n_tokens"))


@query("encode_pair_bertweet", TOKS + f"""
SELECT doc_id, array_to_string({seq_sql(128, '<s>', '</s>')}, ' ') AS seq,
       CAST(list_position({seq_sql(128, '<s>', '</s>')}, '</s>') AS INTEGER) AS span_start
FROM pv""")
def q_encode_pair_bertweet(spark, sf):
    df = E.target_span(E.encode_pair(token_pairs(spark, sf), model="Bertweet", max_len=128), model="Bertweet")
    return df.select("doc_id", F.array_join("seq", " ").alias("seq"), "span_start")


@query("pad_truncate", TOKS + f""", s AS (SELECT doc_id, {seq_sql(128)} AS seq FROM pv)
SELECT doc_id, CAST(len(seq) AS BIGINT) AS n_tokens,
       array_to_string(list_concat(seq, list_resize(['<pad>'], 128 - len(seq), '<pad>')), ' ') AS input_tokens,
       CAST(len(seq) AS BIGINT) AS mask_ones, 128 AS mask_len
FROM s""")
def q_pad_truncate(spark, sf):
    df = E.pad_truncate(E.encode_pair(token_pairs(spark, sf), max_len=128), max_len=128)
    ones = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("doc_id", F.col("n_tokens").cast("long"), F.array_join("input_tokens", " ").alias("input_tokens"),
                     ones.alias("mask_ones"), F.size("attention_mask").alias("mask_len"))


def spans_by_length(spark, sf, lens=(128, 8192)):
    """Spans at several lengths; every text is tokenised once."""
    tp = token_pairs(spark, sf).withColumn("max_len", F.explode(F.array(*[F.lit(n) for n in lens])))
    return E.target_span(E.encode_pair(tp, max_len=F.col("max_len")))


@query("target_span", TOKS + spans_sql() + """
SELECT doc_id, max_len, span_start, span_end FROM sp""")
def q_target_span(spark, sf):
    return spans_by_length(spark, sf).select("doc_id", "max_len", "span_start", "span_end")


@query("extra_long", TOKS + spans_sql() + """
SELECT max_len, target, count(*) FILTER (WHERE span_end IS NULL) AS n_extra_long, count(*) AS n_rows
FROM sp GROUP BY max_len, target""")
def q_extra_long(spark, sf):
    return E.extra_long(spans_by_length(spark, sf), ["max_len", "target"])


@query("ta_bias", TOKS + spans_sql((128,)) + f"""
SELECT doc_id, span_start, span_end, {ALPHA}::DOUBLE AS alpha,
       CAST(coalesce(span_end - span_start, 0) * coalesce(span_end - span_start, 0) AS BIGINT) AS n_cells
FROM sp""")
def q_ta_bias(spark, sf):
    return E.ta_bias(encoded(spark, sf, 128), ALPHA).select("doc_id", "span_start", "span_end", "alpha", "n_cells")


@query("ta_bias_cells", TOKS + spans_sql((128,)) + f"""
SELECT doc_id, CAST(j.j AS INTEGER) AS j, CAST(k.k AS INTEGER) AS k, {ALPHA}::DOUBLE AS bias
FROM sp, LATERAL (SELECT unnest(range(span_start, span_end)) AS j) j,
     LATERAL (SELECT unnest(range(span_start, span_end)) AS k) k
WHERE span_end > span_start""")
def q_ta_bias_cells(spark, sf):
    return E.ta_bias_cells(E.ta_bias(encoded(spark, sf, 128), ALPHA))


def _head_mask_sql():
    masks = []
    for s in MASK_SPECS:
        lf, hf = E.parse_mask_spec(s)
        masks.append(f"SELECT {lit(s)} AS mask, {lf} AS lf, {hf} AS hf")
    return TOKS + spans_sql((128,)) + f""",
m AS ({' UNION ALL '.join(masks)}),
g AS (SELECT m.mask, CAST(l.layer AS INTEGER) AS layer, CAST(h.head AS INTEGER) AS head,
             CASE WHEN l.layer < m.lf * 12 - 1e-9 AND h.head < m.hf * 12 - 1e-9 THEN 1 ELSE 0 END AS "on"
      FROM m, range(12) l(layer), range(12) h(head))
SELECT sp.doc_id, g.mask, g.layer, g.head, g."on",
       round(g."on" * {ALPHA}::DOUBLE * coalesce(span_end - span_start, 0) * coalesce(span_end - span_start, 0), 6)
         AS bias_mass
FROM sp, g"""


@query("head_mask_bias", _head_mask_sql())
def q_head_mask_bias(spark, sf):
    spans = E.ta_bias(encoded(spark, sf, 128), ALPHA)
    return rounded(E.head_mask_bias(spans, MASK_SPECS))


# Twelve layers and heads: a quarter is 3, a half 6, three quarters 9.
@query("head_mask_mass", TOKS + spans_sql((128,)) + f""",
m(mask, layers_on, heads_on) AS (VALUES ('0.50l_0.25h', 6, 3), ('0.50l_0.50h', 6, 6), ('0.50l_1.00h', 6, 12),
                                       ('1.00l_0.25h', 12, 3), ('1.00l_0.50h', 12, 6))
SELECT sp.doc_id, m.mask, m.layers_on, m.heads_on, round(mass, 6) AS mass,
       round(mass * m.layers_on * m.heads_on, 6) AS total_mass
FROM (SELECT doc_id, {ALPHA}::DOUBLE * coalesce(span_end - span_start, 0) * coalesce(span_end - span_start, 0) AS mass
      FROM sp) sp, m""")
def q_head_mask_mass(spark, sf):
    return rounded(E.head_mask_mass(E.ta_bias(encoded(spark, sf, 128), ALPHA), MASK_SPECS))


# --- E8 / E9 -------------------------------------------------------------------

def _updates(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents")
    u1 = lab.filter(F.col("toxic") == 1).select("doc_id", F.lit(0.8).alias("alpha"), F.lit(0).alias("update_seq"))
    u2 = lab.filter(F.col("quality") == 1).select("doc_id", F.lit(0.2).alias("alpha"), F.lit(1).alias("update_seq"))
    u3 = docs.filter(F.col("n_chars") < 400).select("doc_id", F.lit(0.3).alias("alpha"), F.lit(2).alias("update_seq"))
    return u1.unionByName(u2).unionByName(u3)


@query("update_by_ids", TOKS + spans_sql((128,)) + f""",
u AS (SELECT doc_id, 0.8::DOUBLE AS alpha, 0 AS seq FROM labels WHERE toxic = 1
      UNION ALL SELECT doc_id, 0.2::DOUBLE, 1 FROM labels WHERE quality = 1
      UNION ALL SELECT doc_id, 0.3::DOUBLE, 2 FROM documents WHERE n_chars < 400),
f AS (SELECT doc_id, alpha FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rk FROM u)
      WHERE rk = 1)
SELECT sp.doc_id, round(coalesce(f.alpha, {ALPHA}::DOUBLE), 6) AS alpha, f.alpha IS NOT NULL AS updated
FROM sp LEFT JOIN f USING (doc_id)""")
def q_update_by_ids(spark, sf):
    base = E.ta_bias(encoded(spark, sf, 128), ALPHA).select("doc_id", "alpha")
    return rounded(E.update_by_ids(base, _updates(spark, sf), "doc_id", "alpha"))


@query("assign_batches", with_views(STANCE_VIEW) + """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS batch_pos,
       CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 32) AS BIGINT) AS batch
FROM stance_view""")
def q_assign_batches(spark, sf):
    return assign_batches(stance_view(spark, sf).select("doc_id"), 32, "doc_id")


@query("assign_batches_shuffled", with_views(STANCE_VIEW) + """, h AS (
  SELECT doc_id, ('0x' || substr(md5('7:' || CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS hk FROM stance_view)
SELECT doc_id, row_number() OVER (ORDER BY hk, doc_id) - 1 AS batch_pos,
       CAST(floor((row_number() OVER (ORDER BY hk, doc_id) - 1) / 32) AS BIGINT) AS batch
FROM h""")
def q_assign_batches_shuffled(spark, sf):
    return assign_batches(stance_view(spark, sf).select("doc_id"), 32, "doc_id", shuffle_seed=7)


# --- E10-E12 -----------------------------------------------------------------

def vocab_frame(spark, sf):
    tp = split_by_key(token_pairs(spark, sf), "doc_id")
    train = tp.filter(F.col("split") == "train")
    sets = [tp.select("tokens"), train.select(F.col("target_tokens").alias("tokens"))]
    return E.build_vocab(sets)


VOCAB_SQL = TOKS + """, sp AS (SELECT *, doc_id % 10 < 8 AS is_train FROM pv),
t AS (SELECT unnest(toks) AS token FROM sp UNION ALL SELECT unnest(tgt) FROM sp WHERE is_train),
c AS (SELECT token, count(*) AS count FROM t WHERE token <> '<pad>' GROUP BY token),
vocab AS (SELECT '<pad>' AS token, 0::BIGINT AS count, 0::BIGINT AS idx
          UNION ALL SELECT token, count, row_number() OVER (ORDER BY count DESC, token) AS idx FROM c)"""


@query("vocab", VOCAB_SQL + """
SELECT token, count, idx FROM vocab""")
def q_vocab(spark, sf):
    return vocab_frame(spark, sf)


def vectors_frame(spark, sf):
    """The vector table: the k-th regular vocabulary entry (idx = vec_id + 1)
    takes the vector of vec_id, read first-N by rank."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("rank"), F.col("embedding").alias("vector"))
    first = E.read_vectors(emb, VOCAB_VECTORS, "rank")
    return first.select((F.col("rank") + 1).alias("idx"), "vector")


def _fallback_sql(dims=64, seed=1):
    return (f"list_sum(list_transform(range({dims}), lambda i: -0.25 + "
            f"('0x' || substr(md5('{seed}:' || token || ':' || CAST(i AS VARCHAR)), 1, 8))::BIGINT "
            f"/ 4294967296.0 * 0.5))")


EMBED_SQL = VOCAB_SQL + f""",
vec AS (SELECT v.token, CAST(e.embedding AS DOUBLE[]) AS vector
        FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT {VOCAB_VECTORS}) e JOIN vocab v ON v.idx - 1 = e.vec_id),
emb AS (SELECT vocab.token, vocab.idx,
               CASE WHEN vec.vector IS NOT NULL THEN 'known' WHEN vocab.token = '<pad>' THEN 'pad' ELSE 'random' END
                 AS kind,
               CASE WHEN vec.vector IS NOT NULL THEN list_sum(vec.vector) WHEN vocab.token = '<pad>' THEN 0.0
                    ELSE {_fallback_sql()} END AS v_sum
        FROM vocab LEFT JOIN vec USING (token))"""


@query("vocab_vectors", EMBED_SQL + """
SELECT token, idx, kind, round(v_sum, 6) AS v_sum FROM emb""")
def q_vocab_vectors(spark, sf):
    vocab = vocab_frame(spark, sf)
    emb = E.embed_vocab(vocab, vectors_frame(spark, sf), dims=64, seed=1, key="idx")
    v_sum = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return rounded(emb.select("token", "idx", "kind", v_sum.alias("v_sum")))


@query("vocab_coverage", EMBED_SQL + """
SELECT count(*) AS vocab_size, count(*) FILTER (WHERE kind = 'known') AS n_known,
       round(avg(CASE WHEN kind = 'known' THEN 1.0 ELSE 0.0 END), 6) AS known_share FROM emb""")
def q_vocab_coverage(spark, sf):
    vocab = vocab_frame(spark, sf)
    emb = E.embed_vocab(vocab, vectors_frame(spark, sf), dims=64, seed=1, key="idx")
    return rounded(E.vocab_coverage(emb))
