"""Registered text, label and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanceflow.functions.labels import decode_label, encode_label
from stanceflow.functions.text import clean_aspect_tokens, clean_stance_tokens, normalize_tokens
from stanceflow.operators import labels as L
from stanceflow.operators import text as T
from stanceflow.operators.align import align_by_position
from stanceflow.operators.index import with_row_index
from stanceflow.operators.ordering import number_rows
from stanceflow.plans.registry import query, rounded
from stanceflow.plans.sqlviews import (
    STANCE_VIEW, lit, sql_clean_aspect, sql_clean_stance, sql_normalize, with_views,
)
from stanceflow.plans.views import DICT_BASE, DICT_OVERRIDE, dictionary_frames, nested_view, stance_view, table
from stanceflow.sources.readers import flatten_aspects, parse_aspect_cell, split_aspect_cells, split_by_key


def merged_pairs():
    """The literal dictionary after the override (later source wins)."""
    d = dict(DICT_BASE)
    d.update({k: v.rstrip() for k, v in DICT_OVERRIDE})
    return list(d.items())


SV = with_views(STANCE_VIEW)


def _tok_out(col):
    """Joined tokens and their count from a token column (reference it by
    name after a projection, so the cleaning runs once per row)."""
    return [F.array_join(col, " ").alias("tokens"), F.size(col).cast("long").alias("n_tokens")]


@query("clean_stance_tokens", f"""
SELECT doc_id, array_to_string({sql_clean_stance('text', merged_pairs())}, ' ') AS tokens,
       CAST(len({sql_clean_stance('text', merged_pairs())}) AS BIGINT) AS n_tokens,
       array_to_string({sql_clean_stance('lang', merged_pairs())}, ' ') AS target_tokens
FROM documents""")
def q_clean_stance(spark, sf):
    docs = table(spark, sf, "documents")
    pairs = merged_pairs()
    cleaned = docs.select("doc_id", clean_stance_tokens("text", pairs).alias("_t"),
                          F.array_join(clean_stance_tokens("lang", pairs), " ").alias("target_tokens"))
    return cleaned.select("doc_id", *_tok_out(F.col("_t")), "target_tokens")


@query("clean_aspect_tokens", f"""
SELECT doc_id, array_to_string({sql_clean_aspect('text')}, ' ') AS tokens,
       CAST(len({sql_clean_aspect('text')}) AS BIGINT) AS n_tokens
FROM documents""")
def q_clean_aspect(spark, sf):
    docs = table(spark, sf, "documents")
    cleaned = docs.select("doc_id", clean_aspect_tokens("text").alias("_t"))
    return cleaned.select("doc_id", *_tok_out(F.col("_t")))


@query("normalize_map", f"""
SELECT doc_id, array_to_string({sql_normalize(sql_clean_aspect('text'), merged_pairs())}, ' ') AS tokens,
       CAST(len({sql_normalize(sql_clean_aspect('text'), merged_pairs())}) AS BIGINT) AS n_tokens
FROM documents""")
def q_normalize_map(spark, sf):
    docs = table(spark, sf, "documents")
    cleaned = docs.select("doc_id", normalize_tokens(clean_aspect_tokens("text"), merged_pairs()).alias("_t"))
    return cleaned.select("doc_id", *_tok_out(F.col("_t")))


@query("normalize_join", f"""
SELECT doc_id, array_to_string({sql_normalize(sql_clean_aspect('text'), merged_pairs())}, ' ') AS tokens,
       CAST(len({sql_normalize(sql_clean_aspect('text'), merged_pairs())}) AS BIGINT) AS n_tokens
FROM documents""")
def q_normalize_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", clean_aspect_tokens("text").alias("tokens"))
    base, over = dictionary_frames(spark)
    merged = T.merge_dicts(base, over)
    out = T.normalize_join(docs, merged, key="doc_id", tokens="tokens", out="norm")
    return out.select("doc_id", *_tok_out(F.col("norm")))


def large_dictionary(spark, sf):
    """Thousands of entries from the corpus: every token of eight or more
    letters is split in two."""
    tok = table(spark, sf, "documents").select(F.explode(clean_aspect_tokens("text")).alias("slang")).distinct()
    return tok.where(F.length("slang") >= 8).select(
        "slang", F.concat(F.substring("slang", 1, 4), F.lit(" "), F.substring("slang", 5, 1 << 30)).alias("expansion"))


def _split_long(toks: str) -> str:
    return (f"flatten(list_transform({toks}, lambda t: CASE WHEN len(t) >= 8 THEN [t[1:4], t[5:]] ELSE [t] END))")


@query("clean_stance_large_dict", f"""
SELECT doc_id, array_to_string({_split_long(sql_clean_stance('text'))}, ' ') AS tokens,
       CAST(len({_split_long(sql_clean_stance('text'))}) AS BIGINT) AS n_tokens,
       array_to_string({_split_long(sql_clean_stance("lang || ' ' || source"))}, ' ') AS target_tokens
FROM documents""")
def q_clean_stance_large_dict(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.concat_ws(" ", "lang", "source").alias("target"))
    cleaned = T.clean_stance(docs, large_dictionary(spark, sf))
    return cleaned.select("doc_id", *_tok_out(F.col("tokens")),
                          F.array_join("target_tokens", " ").alias("target_tokens"))


def _dict_sql():
    rows = " UNION ALL ".join(f"SELECT {lit(k)} AS slang, {lit(v)} AS expansion" for k, v in merged_pairs())
    return f"""WITH d AS ({rows}),
toks AS (SELECT unnest({sql_clean_aspect('text')}) AS token FROM documents)
SELECT d.slang, d.expansion, count(t.token) AS n_hits
FROM d LEFT JOIN toks t ON t.token = d.slang GROUP BY d.slang, d.expansion"""


@query("dict_merge", _dict_sql())
def q_dict_merge(spark, sf):
    base, over = dictionary_frames(spark)
    merged = T.merge_dicts(base, over)
    toks = table(spark, sf, "documents").select(F.explode(clean_aspect_tokens("text")).alias("token"))
    # the merged dictionary comes from literal sources: a proven small size
    hits = toks.join(F.broadcast(merged.select("slang")), toks.token == merged.slang).groupBy("slang").agg(
        F.count(F.lit(1)).alias("n_hits"))
    return (merged.join(hits, "slang", "left")
            .select("slang", "expansion", F.coalesce("n_hits", F.lit(0)).alias("n_hits")))


@query("cap_tokens", SV + f"""
SELECT doc_id, CAST(len({sql_clean_aspect('text')}) AS BIGINT) AS n_before,
       len({sql_clean_aspect('text')}) > 100 AS over_cap,
       array_to_string({sql_clean_aspect('text')}[1:100], ' ') AS tokens
FROM stance_view""")
def q_cap_tokens(spark, sf):
    sv = stance_view(spark, sf).select("doc_id", clean_aspect_tokens("text").alias("tokens"))
    capped = T.cap_tokens(sv, "tokens", 100)
    return capped.select("doc_id", F.col("n_before").cast("long"), "over_cap",
                         F.array_join("tokens", " ").alias("tokens"))


def _length_sql():
    n = f"len({sql_clean_stance('text', merged_pairs())})"
    return SV + f""", l AS (SELECT target, {n} AS n FROM stance_view)
SELECT 'Covid19' AS dataset, target, count(*) AS n_rows, max(n) AS max_len, round(avg(least(n, 100)), 6) AS avg_len,
       count(*) FILTER (WHERE n > 100) AS n_over_cap, max(least(n, 100)) > 140 AS overflow FROM l GROUP BY target
UNION ALL
SELECT 'SemEval2016', target, count(*), max(n), round(avg(n), 6), count(*) FILTER (WHERE n > 100), max(n) > 120
FROM l GROUP BY target"""


@query("length_profile", _length_sql())
def q_length_profile(spark, sf):
    sv = stance_view(spark, sf).select("target", clean_stance_tokens("text", merged_pairs()).alias("tokens"))
    return rounded(T.length_profiles(sv, ("Covid19", "SemEval2016"), ["target"]).select(
        "dataset", "target", "n_rows", F.col("max_len").cast("long"), "avg_len", "n_over_cap", "overflow"))


# --- labels ----------------------------------------------------------------

@query("label_encode", SV + """
SELECT doc_id, stance, CAST(CASE stance WHEN 'AGAINST' THEN 0 WHEN 'NONE' THEN 1 WHEN 'FAVOR' THEN 2 END AS INTEGER)
       AS y_enc,
       CAST(CASE CASE stance WHEN 'AGAINST' THEN 'NEG' WHEN 'NONE' THEN 'NEU' ELSE 'POS' END
            WHEN 'NEG' THEN 0 WHEN 'NEU' THEN 1 WHEN 'POS' THEN 2 END AS INTEGER) AS y_polarity
FROM stance_view""")
def q_label_encode(spark, sf):
    sv = stance_view(spark, sf).select("doc_id", "stance")
    pol = (F.when(F.col("stance") == "AGAINST", "NEG").when(F.col("stance") == "NONE", "NEU").otherwise("POS"))
    out = L.encode_labels(sv, "stance", "y_enc", "stance")
    return out.withColumn("y_polarity", encode_label(pol, "polarity"))


@query("label_decode", SV + """
SELECT doc_id, y, CASE y WHEN 0 THEN 'NEG' WHEN 1 THEN 'NEU' WHEN 2 THEN 'POS' END AS polarity_label,
       CASE y WHEN 0 THEN 'Against' WHEN 1 THEN 'None' WHEN 2 THEN 'Favor' END AS stance_label
FROM stance_view""")
def q_label_decode(spark, sf):
    sv = stance_view(spark, sf).select("doc_id", "y")
    return L.decode_labels(sv, "y", "polarity_label", "polarity").withColumn(
        "stance_label", decode_label("y", "stance"))


_RAW_LABEL_SQL = """CASE WHEN l.toxic = 1 AND l.quality = 1 THEN 'MIXED' WHEN l.toxic = 1 THEN 'AGAINST'
                       WHEN l.quality = 1 THEN 'FAVOR' ELSE 'NONE' END"""


@query("quarantine", f"""
SELECT d.doc_id, {_RAW_LABEL_SQL} AS raw_label, 'label outside domain' AS reason
FROM documents d JOIN labels l USING (doc_id)
WHERE {_RAW_LABEL_SQL} NOT IN ('AGAINST', 'NONE', 'FAVOR')""")
def q_quarantine(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels")
    raw = (F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "MIXED").when(F.col("toxic") == 1, "AGAINST")
           .when(F.col("quality") == 1, "FAVOR").otherwise("NONE"))
    df = docs.join(lab, "doc_id").withColumn("raw_label", raw)
    _valid, bad = L.split_valid(df, "raw_label", "stance", text_col="text")
    return bad.select("doc_id", "raw_label", "reason")


@query("aux_frame", SV + """
SELECT text, 1 AS target_id, y FROM stance_view WHERE y <> 1""")
def q_aux_frame(spark, sf):
    sv = stance_view(spark, sf).withColumn("target_id", F.lit(1))
    return L.aux_frame(sv, "text", "target_id", "y")


@query("distinct_rows", SV + """
SELECT DISTINCT text, target, stance FROM stance_view""")
def q_distinct_rows(spark, sf):
    return L.distinct_rows(stance_view(spark, sf).select("text", "target", "stance"))


@query("head_limit_large", SV + """
SELECT doc_id, target FROM stance_view ORDER BY doc_id DESC LIMIT 20000""")
def q_head_limit_large(spark, sf):
    sv = stance_view(spark, sf).select("doc_id", "target")
    return L.head_limit(sv, 20_000, F.col("doc_id").desc())


@query("row_index_nulls", SV + """,
k AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE -(doc_id // 2) END AS k, target FROM stance_view)
SELECT doc_id, k, row_number() OVER (ORDER BY k NULLS FIRST, doc_id) - 1 AS idx,
       row_number() OVER (ORDER BY k DESC NULLS LAST, doc_id) - 1 AS idx_desc,
       row_number() OVER (PARTITION BY target ORDER BY k NULLS FIRST, doc_id) - 1 AS idx_target
FROM k""")
def q_row_index_nulls(spark, sf):
    """Null, repeated and descending keys, over the whole view."""
    k = F.when(F.pmod(F.col("doc_id"), F.lit(7)) == 3, F.lit(None)).otherwise(-F.floor(F.col("doc_id") / 2))
    df = stance_view(spark, sf).select("doc_id", "target", k.cast("long").alias("k"))
    df = with_row_index(df, "k", tie_break=["doc_id"])
    df = with_row_index(df, "k", "idx_desc", tie_break=["doc_id"], descending=True)
    df = with_row_index(df, "k", "idx_target", ["target"], ["doc_id"])
    return df.select("doc_id", "k", "idx", "idx_desc", "idx_target")


@query("row_index_string", SV + """
SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)) DESC) - 1 AS idx,
       row_number() OVER (PARTITION BY target ORDER BY stance, md5(CAST(doc_id AS VARCHAR))) - 1 AS idx_target
FROM stance_view""")
def q_row_index_string(spark, sf):
    """String keys, descending and repeated, over the whole view."""
    df = stance_view(spark, sf).select("doc_id", "target", "stance", F.md5(F.col("doc_id").cast("string")).alias("k"))
    df = number_rows(number_rows(df, [("k", True)]), ["stance"], "idx_target", ["target"], ["k"])
    return df.select("doc_id", "idx", "idx_target")


@query("row_index_decimal", SV + """
SELECT doc_id, k, row_number() OVER (ORDER BY k NULLS FIRST, doc_id) - 1 AS idx
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN NULL ELSE CAST(1000 - doc_id % 37 AS DECIMAL(20,2)) / 8 END AS k0,
             CAST(CASE WHEN doc_id % 5 = 2 THEN NULL ELSE (1000 - doc_id % 37) * 12.5 END AS DECIMAL(20,2)) AS k
      FROM stance_view)""")
def q_row_index_decimal(spark, sf):
    """A decimal key with nulls and many repeats."""
    k = F.when(F.pmod(F.col("doc_id"), F.lit(5)) != 2, (1000 - F.pmod(F.col("doc_id"), F.lit(37))) * F.lit(12.5))
    df = stance_view(spark, sf).select("doc_id", k.cast("decimal(20,2)").alias("k"))
    return number_rows(df, ["k"], tie_break=["doc_id"]).select("doc_id", "k", "idx")


@query("row_index_sparse", SV + """
SELECT doc_id, k, row_number() OVER (ORDER BY k) - 1 AS idx
FROM (SELECT doc_id, (doc_id % 1000) * 9007199254740993 + doc_id AS k FROM stance_view)""")
def q_row_index_sparse(spark, sf):
    """Integer keys spread over 63 bits."""
    k = F.pmod(F.col("doc_id"), F.lit(1000)) * F.lit(9007199254740993) + F.col("doc_id")
    return number_rows(stance_view(spark, sf).select("doc_id", k.alias("k")), ["k"]).select("doc_id", "k", "idx")


@query("row_index_one_value", SV + """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, 'same' AS k FROM stance_view""")
def q_row_index_one_value(spark, sf):
    """One key value that all rows share: numbers 0 to n - 1, in any order."""
    return number_rows(stance_view(spark, sf).select(F.lit("same").alias("k")), ["k"]).select("idx", "k")


@query("first_n_half", SV + """, r AS (
SELECT doc_id, target, md5(CAST(doc_id AS VARCHAR)) AS k, count(*) OVER () AS n,
       row_number() OVER (ORDER BY target DESC, md5(CAST(doc_id AS VARCHAR))) AS place FROM stance_view)
SELECT doc_id, target, k FROM r WHERE place <= n // 2""")
def q_first_n_half(spark, sf):
    """Half of the rows, by selection: no sort of them anywhere."""
    sv = stance_view(spark, sf).select("doc_id", "target", F.md5(F.col("doc_id").cast("string")).alias("k"))
    return L.head_limit(sv, sv.count() // 2, [("target", True), "k"], in_one_task=16)


@query("align_by_string", SV + """, l AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS i FROM stance_view),
r AS (SELECT doc_id, target, row_number() OVER (ORDER BY target, stance, doc_id) AS i FROM stance_view)
SELECT l.doc_id, r.doc_id AS r_doc_id, r.target AS r_target FROM l JOIN r USING (i)""")
def q_align_by_string(spark, sf):
    """Two files that belong together by position, in the order of string keys."""
    sv = stance_view(spark, sf)
    left = sv.select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("k"))
    right = sv.select("doc_id", "target", F.concat_ws("|", "target", "stance", F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("k"))
    return align_by_position(left, right, "k", "k").select("doc_id", "r_doc_id", "r_target")


@query("head_limit", SV + """
SELECT doc_id, target, stance FROM stance_view ORDER BY doc_id LIMIT 100""")
def q_head_limit(spark, sf):
    return L.head_limit(stance_view(spark, sf).select("doc_id", "target", "stance"), 100, "doc_id")


@query("splits_union", SV + """
SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split,
       target, y
FROM stance_view""")
def q_splits_union(spark, sf):
    sv = split_by_key(stance_view(spark, sf).select("doc_id", "target", "y"), "doc_id")
    return sv.select("doc_id", "split", "target", "y")


@query("split_profile", SV + """
SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split,
       stance, count(*) AS n_rows
FROM stance_view GROUP BY ROLLUP (1, stance)""")
def q_split_profile(spark, sf):
    sv = split_by_key(stance_view(spark, sf).select("doc_id", "stance"), "doc_id")
    return L.label_profile(sv, ["split", "stance"])


# --- nested sources --------------------------------------------------------

def _nested_aspects(spark, sf):
    """conversations as nested aspect documents: the first turn is the text,
    every later turn an aspect (its words as the term, role as polarity)."""
    nv = nested_view(spark, sf)
    aspects = F.transform(F.slice("turns", F.lit(2), F.size("turns") - 1),
                          lambda t: F.struct(F.split(t["text"], " ").alias("term"),
                                             t["role"].alias("polarity")))
    return nv.select("conv_id", F.col("turns")[0]["text"].alias("raw_words"), aspects.alias("aspects"))


@query("flatten_aspects", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f AS (SELECT conv_id, text AS raw_words FROM c WHERE rn = 1)
SELECT DISTINCT f.raw_words AS text, c.text AS aspect,
       c.role AS polarity
FROM c JOIN f USING (conv_id) WHERE c.rn > 1""")
def q_flatten_aspects(spark, sf):
    flat = flatten_aspects(_nested_aspects(spark, sf))
    return L.distinct_rows(flat)


@query("aspect_cell", """
SELECT conv_id,
       CASE WHEN role = 'system' THEN NULL ELSE lower(array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ')) END AS aspect,
       CASE WHEN role = 'system' THEN 'none' WHEN role = 'user' THEN 'positive' ELSE 'negative' END AS polarity,
       role <> 'system' AS has_aspect
FROM conversations""")
def q_aspect_cell(spark, sf):
    return parse_aspect_cell(aspect_cells(spark, sf), "cell", keep=["conv_id"])


# Every third conversation's cell is cut off, every third has no cell at all.
@query("aspect_cell_quarantine", """
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'no list' ELSE 'missing cell' END AS reason
FROM conversations GROUP BY conv_id HAVING conv_id % 3 <> 2""")
def q_aspect_cell_quarantine(spark, sf):
    third = F.col("conv_id") % 3
    cells = aspect_cells(spark, sf).withColumn("cell", F.when(third == 0, F.expr("left(cell, length(cell) - 2)"))
                                               .when(third == 2, F.col("cell")))
    return split_aspect_cells(cells, "cell", keep=["conv_id"])[1].select("conv_id", "reason")


@query("aspect_cell_readable", """
SELECT conv_id,
       CASE WHEN role = 'system' THEN NULL ELSE lower(array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ')) END AS aspect,
       CASE WHEN role = 'system' THEN 'none' WHEN role = 'user' THEN 'positive' ELSE 'negative' END AS polarity,
       role <> 'system' AS has_aspect
FROM conversations WHERE conv_id % 3 <> 0""")
def q_aspect_cell_readable(spark, sf):
    cells = aspect_cells(spark, sf).withColumn(
        "cell", F.when(F.col("conv_id") % 3 == 0, F.expr("left(cell, length(cell) - 2)")).otherwise(F.col("cell")))
    return split_aspect_cells(cells, "cell", keep=["conv_id"])[0]


def aspect_cells(spark, sf):
    conv = table(spark, sf, "conversations")
    term = F.when(F.col("role") == "system", F.lit("noaspectterm")).otherwise(
        F.lower(F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), " ")))
    pol = (F.when(F.col("role") == "system", "none").when(F.col("role") == "user", "positive")
           .otherwise("negative"))
    item = F.concat(F.lit("{'term': '"), term, F.lit("', 'polarity': '"), pol, F.lit("'}"))
    # one literal-list cell per conversation, items in turn order
    items = F.array_sort(F.collect_list(F.struct("turn", item.alias("item"))))
    return conv.groupBy("conv_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["item"]), ", "), F.lit("]")).alias("cell"))
