"""Registered alignment and perturbation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanceflow.operators import align as J
from stanceflow.operators import parse as PL
from stanceflow.operators import perturb as T
from stanceflow.operators.index import with_row_index
from stanceflow.operators.keywords import explicit_flag_many
from stanceflow.plans.q_generation import GV, _free_sql
from stanceflow.plans.registry import query
from stanceflow.plans.sqlviews import STANCE_VIEW, lit, with_views
from stanceflow.plans.views import generation_view, stance_view, table
from stanceflow.sources.readers import split_by_key

SV = with_views(STANCE_VIEW)

# Our own perturbation dictionaries for the four targets of the stance view.
NEGATIONS = {"en": "not en", "de": "nicht de"}
KEYWORDS = {"en": ["the", "and"], "de": ["der", "und"], "es": ["el", "que"], "fr": ["le", "et"]}


def reference_file(spark, sf):
    """The second file of the zero-shot evaluation: every labelled document
    (post, seen?) where toxic rows were re-encoded (upper case) and neutral
    rows got a trailing space."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels")
    post = (F.when(F.col("toxic") == 1, F.upper("text"))
            .when(F.col("quality") == 0, F.concat(F.col("text"), F.lit(" "))).otherwise(F.col("text")))
    return docs.join(lab, "doc_id").select("doc_id", post.alias("post"), F.col("quality").alias("seen"))


REF_SQL = """ref AS (
  SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN upper(d.text) WHEN l.quality = 0 THEN d.text || ' ' ELSE d.text END
         AS post, l.quality AS seen
  FROM documents d JOIN labels l USING (doc_id))"""


@query("zero_shot_subset", GV + f""", {REF_SQL},
pa AS (SELECT doc_id, {_free_sql('generated_text')} AS generated_stance,
              row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM generation_view),
ra AS (SELECT seen, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM ref)
SELECT row_number() OVER (ORDER BY pa.idx) - 1 AS new_idx, pa.doc_id, pa.generated_stance
FROM pa JOIN ra USING (idx) WHERE ra.seen = 0""")
def q_zero_shot_subset(spark, sf):
    parsed = PL.parse_generations(generation_view(spark, sf), "free").select("doc_id", "generated_stance")
    return J.zero_shot_subset(parsed, reference_file(spark, sf), "doc_id", "doc_id", "seen")


@query("alignment_audit", SV + f""", {REF_SQL},
la AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM stance_view),
ra AS (SELECT doc_id AS r_doc_id, post, seen, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM ref),
ign AS (SELECT DISTINCT ra.idx FROM ra JOIN labels l ON l.doc_id = ra.r_doc_id WHERE l.toxic = 1),
al AS (SELECT coalesce(la.idx, ra.idx) AS idx, la.doc_id, la.text, ra.r_doc_id, ra.post, ra.seen
       FROM la FULL OUTER JOIN ra ON la.idx = ra.idx),
fl AS (SELECT al.*, ign.idx IS NOT NULL AS ignored FROM al LEFT JOIN ign ON ign.idx = al.idx)
SELECT count(doc_id) AS n_left, count(r_doc_id) AS n_right, count(*) FILTER (WHERE NOT ignored) AS n_compared,
       count(*) FILTER (WHERE ignored) AS n_ignored,
       count(*) FILTER (WHERE NOT ignored AND text IS DISTINCT FROM post) AS n_mismatch,
       count(*) FILTER (WHERE seen = 0) AS n_subset,
       count(doc_id) = count(r_doc_id) AS length_ok,
       count(*) FILTER (WHERE NOT ignored AND text IS DISTINCT FROM post) = 0 AS text_ok,
       count(*) FILTER (WHERE seen = 0) = 58 AS subset_ok
FROM fl""")
def q_alignment_audit(spark, sf):
    left = stance_view(spark, sf).select("doc_id", "text")
    ref = reference_file(spark, sf)
    toxic = table(spark, sf, "labels").filter(F.col("toxic") == 1).select("doc_id")
    ref_idx = with_row_index(ref.select("doc_id"), "doc_id", out="idx")
    ignore = ref_idx.join(toxic, "doc_id", "left_semi").select("idx")
    return J.alignment_audit(left, ref, "doc_id", "doc_id", "text", "post", ignore=ignore, seen="seen",
                             expected_subset=58)


@query("alignment_differences", SV + f""", {REF_SQL},
la AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM stance_view),
ra AS (SELECT doc_id AS r_doc_id, post, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM ref WHERE seen = 1)
SELECT coalesce(la.idx, ra.idx) AS idx, doc_id AS left_key, r_doc_id AS right_key,
       CASE WHEN ra.idx IS NULL THEN 'left only' WHEN la.idx IS NULL THEN 'right only' ELSE 'text' END AS kind
FROM la FULL OUTER JOIN ra ON la.idx = ra.idx
WHERE ra.idx IS NULL OR la.idx IS NULL OR text IS DISTINCT FROM post""")
def q_alignment_differences(spark, sf):
    """Positions at which the second file, without its unseen rows, differs."""
    ref = reference_file(spark, sf).where(F.col("seen") == 1)
    return J.differing_positions(stance_view(spark, sf).select("doc_id", "text"), ref, "doc_id", "doc_id", "text", "post",
                                 levels=2, chunk=32)


@query("mask_targets", SV + """
SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN '' ELSE target END AS target, target AS orig_target,
       CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split
FROM stance_view""")
def q_mask_targets(spark, sf):
    sv = split_by_key(stance_view(spark, sf).select("doc_id", "target"), "doc_id")
    return T.mask_targets(sv, "target", "split", "test").select("doc_id", "target", "orig_target", "split")


@query("shuffle_targets", SV + """,
a AS (SELECT doc_id, target, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM stance_view),
b AS (SELECT target AS new_target,
             row_number() OVER (ORDER BY ('0x' || substr(md5('1433:' || CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT,
                                doc_id) - 1 AS idx
      FROM stance_view)
SELECT a.doc_id, b.new_target AS target, a.target AS orig_target FROM a JOIN b USING (idx)""")
def q_shuffle_targets(spark, sf):
    sv = stance_view(spark, sf).select("doc_id", "target")
    return T.shuffle_targets(sv, "doc_id", "target", seed=1433).select("doc_id", "target", "orig_target")


def _neg_sql() -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in NEGATIONS.items())
    return SV + f"""
SELECT doc_id, coalesce(CASE target {cases} END, target) AS target, target AS orig_target,
       CAST(CASE y WHEN 2 THEN 0 WHEN 0 THEN 2 ELSE y END AS INTEGER) AS y, y AS y_orig
FROM stance_view"""


@query("negate_targets", _neg_sql())
def q_negate_targets(spark, sf):
    sv = stance_view(spark, sf).select("doc_id", "target", "y")
    neg = T.literal_frame(spark, NEGATIONS, "target", "negated", "string")
    return T.negate_targets(sv, neg).select("doc_id", "target", "orig_target", "y", "y_orig")


def _explicit_sql() -> str:
    branches = " ".join(
        f"WHEN target = {lit(t)} THEN " + " OR ".join(f"contains(text, {lit(k)})" for k in kws)
        for t, kws in KEYWORDS.items())
    return SV + f"""
SELECT doc_id, target, CASE {branches} END AS explicit FROM stance_view"""


@query("explicit_split", _explicit_sql())
def q_explicit_split(spark, sf):
    sv = stance_view(spark, sf).select("doc_id", "target", "text")
    kw = T.literal_frame(spark, KEYWORDS, "target", "keywords", "array<string>")
    return T.explicit_flag(sv, kw).select("doc_id", "target", "explicit")


_LAST = "list_aggregate(list_filter(string_split(text, ' '), lambda w: w <> '')[-3:], 'string_agg', ' ')"


@query("explicit_phrases", SV + f""",
kw AS (SELECT DISTINCT target, {_LAST} AS phrase FROM stance_view WHERE stance = 'AGAINST'),
hit AS (SELECT DISTINCT s.doc_id FROM stance_view s JOIN kw ON kw.target = s.target AND contains(s.text, kw.phrase))
SELECT doc_id, target, doc_id IN (SELECT doc_id FROM hit) AS explicit FROM stance_view""")
def q_explicit_phrases(spark, sf):
    """T4 with long lists: a target's keywords are the last three words of each
    of its AGAINST texts."""
    sv = stance_view(spark, sf).select("doc_id", "target", "text", "stance")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    phrase = F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3), " ")
    against = sv.where(F.col("stance") == "AGAINST").select("target", phrase.alias("k"))
    some = against.groupBy("target").agg(F.collect_set("k").alias("keywords"))
    kw = sv.select("target").distinct().join(some, "target", "left") \
        .select("target", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    return explicit_flag_many(sv.drop("stance"), kw).select("doc_id", "target", "explicit")
