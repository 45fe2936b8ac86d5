"""Registered prompting, generation and parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanceflow.functions.labels import encode_prediction
from stanceflow.functions.parse import CHAT_PATTERN_SQL, DICT_PATTERN, FREE_PATTERN
from stanceflow.functions.prompts import HOSTED_TEMPLATES, LLM_TEMPLATES, LOG_PREFIX, SFT_TEMPLATES, render_sql
from stanceflow.operators import metrics as M
from stanceflow.operators import parse as PL
from stanceflow.operators import prompts as G
from stanceflow.plans.registry import query, rounded
from stanceflow.plans.sqlviews import STANCE_VIEW, class_counts, f1c, lit, sql_tokens, with_views
from stanceflow.plans.views import PARSER_STRINGS, generation_view, stance_view

SV = with_views(STANCE_VIEW)


def _gen_view_sql() -> str:
    branches = []
    for i in range(11):
        s = PARSER_STRINGS[i].replace("\n", " ") if i == 4 else PARSER_STRINGS[i]
        branches.append(f"WHEN {i} THEN {lit(s)}")
    return f"""generation_view AS (
  SELECT doc_id, text, target, stance, y, CASE doc_id % 12 {' '.join(branches)} ELSE NULL END AS generated_text
  FROM stance_view)"""


GV = with_views(STANCE_VIEW, _gen_view_sql())

PROMPTS = {
    "prompt_default": LLM_TEMPLATES["default"],
    "prompt_chat_type1": LLM_TEMPLATES["chat-type1"],
    "prompt_chat_type2": LLM_TEMPLATES["chat-type2"],
    "prompt_chat_type3": LLM_TEMPLATES["chat-type3"],
    "prompt_hosted_type1": HOSTED_TEMPLATES["chat-type1"],
    "prompt_hosted_type2": HOSTED_TEMPLATES["chat-type2"],
}


def _register_prompt(key: str, template: str):
    sql = SV + f"SELECT doc_id, {render_sql(template, {'text': 'text', 'target': 'target'})} AS prompt FROM stance_view"

    @query(key, sql)
    def q(spark, sf):
        return G.render_prompt(stance_view(spark, sf), template).select("doc_id", "prompt")
    return q


for _k, _t in PROMPTS.items():
    _register_prompt(_k, _t)


_SFT_VALUES = {"tweet": "text", "tgt": "target", "stance": "stance"}


@query("sft_corpus", SV + f"""
SELECT doc_id, {render_sql(SFT_TEMPLATES['chat-type1'], _SFT_VALUES)} AS text FROM stance_view""")
def q_sft_corpus(spark, sf):
    return G.build_sft(stance_view(spark, sf)).select("doc_id", "text")


def _sft_prefix_sql() -> str:
    tpl = SFT_TEMPLATES["chat-type1"]
    return render_sql(tpl[:tpl.index("$stance")], _SFT_VALUES)


@query("sft_truncate", SV + f""", s AS (
  SELECT doc_id, stance, {render_sql(SFT_TEMPLATES['chat-type1'], _SFT_VALUES)} AS text,
         {_sft_prefix_sql()} AS prefix FROM stance_view)
SELECT doc_id, CAST(len({sql_tokens('text')}) AS BIGINT) AS n_tokens,
       CAST(least(len({sql_tokens('text')}), 4096) AS BIGINT) AS n_kept,
       len({sql_tokens('prefix')}) + len({sql_tokens('stance')}) <= 4096 AS answer_survived
FROM s""")
def q_sft_truncate(spark, sf):
    out = G.truncate_sft(G.build_sft(stance_view(spark, sf)), max_len=4096)
    return out.select("doc_id", "n_tokens", "n_kept", "answer_survived")


# --- echo stripping over generated texts ---------------------------------------

def echoed(spark, sf):
    """Prompts and outputs that repeat their prompt before one of the parser
    strings (a column expression: no model runs)."""
    sv = G.render_prompt(stance_view(spark, sf), LLM_TEMPLATES["chat-type3"])
    k = F.pmod(F.col("doc_id"), F.lit(11))
    said = F.element_at(F.array(*[F.lit(s) for s in PARSER_STRINGS[:11]]), (k + 1).cast("int"))
    return sv.select("doc_id", "prompt", F.concat("prompt", F.lit(" "), said).alias("generated_text"))


def _stub_sql(prompt: str = "prompt") -> str:
    branches = " ".join(f"WHEN {i} THEN {lit(PARSER_STRINGS[i])}" for i in range(11))
    return f"({prompt} || ' ' || CASE doc_id % 11 {branches} END)"


_STUB_CTE = SV + f""", pr AS (
  SELECT doc_id, target, stance, y, {render_sql(LLM_TEMPLATES['chat-type3'], {'text': 'text', 'target': 'target'})}
         AS prompt FROM stance_view),
gen AS (SELECT *, {_stub_sql()} AS generated_text FROM pr),
stripped AS (SELECT *, CASE WHEN prompt = '' THEN generated_text ELSE replace(generated_text, prompt, '') END
             AS answer FROM gen)"""


@query("strip_echo", _STUB_CTE + """
SELECT doc_id, answer AS generated_text FROM stripped""")
def q_strip_echo(spark, sf):
    return G.strip_echo(echoed(spark, sf)).select("doc_id", "generated_text")


@query("gen_log", _STUB_CTE + f"""
SELECT doc_id, {lit(LOG_PREFIX)} || answer AS log_line FROM stripped""")
def q_gen_log(spark, sf):
    return G.gen_log(G.strip_echo(echoed(spark, sf))).select("doc_id", "log_line")


def _chat_sql(col: str) -> str:
    m = f"coalesce(regexp_extract({col}, {lit(CHAT_PATTERN_SQL)}, 1), '')"
    return f"CASE WHEN lower({m}) IN ('no stance', 'nostance', 'neutral') THEN 'NONE' ELSE upper({m}) END"


def _free_sql(col: str) -> str:
    m = f"regexp_extract({col}, {lit(FREE_PATTERN)}, 1)"
    return f"CASE WHEN {col} IS NULL THEN '' WHEN {m} = '' THEN 'NONE' ELSE upper({m}) END"


def _dict_sql(col: str) -> str:
    return f"coalesce(regexp_extract({col}, {lit(DICT_PATTERN)}, 1), '')"


def _p2_sql(col: str) -> str:
    return (f"CAST(CASE WHEN {col} IS NULL OR {col} = '' THEN -1 WHEN {col} = 'AGAINST' THEN 0 "
            f"WHEN {col} = 'NONE' THEN 1 WHEN {col} = 'FAVOR' THEN 2 END AS INTEGER)")


@query("parse_free", GV + f"""
SELECT doc_id, {_free_sql('generated_text')} AS generated_stance FROM generation_view""")
def q_parse_free(spark, sf):
    return PL.parse_generations(generation_view(spark, sf), "free").select("doc_id", "generated_stance")


@query("parse_dict", GV + f"""
SELECT doc_id, {_dict_sql('generated_text')} AS generated_stance FROM generation_view""")
def q_parse_dict(spark, sf):
    return PL.parse_generations(generation_view(spark, sf), "dict").select("doc_id", "generated_stance")


@query("parse_chat", GV + f"""
SELECT doc_id, {_chat_sql('generated_text')} AS generated_stance FROM generation_view""")
def q_parse_chat(spark, sf):
    return PL.parse_generations(generation_view(spark, sf), "chat").select("doc_id", "generated_stance")


@query("prediction_encode", GV + f"""
SELECT doc_id, {_chat_sql('generated_text')} AS generated_stance, {_p2_sql(_chat_sql('generated_text'))} AS p
FROM generation_view""")
def q_prediction_encode(spark, sf):
    out = PL.parse_generations(generation_view(spark, sf), "chat")
    return out.select("doc_id", "generated_stance", encode_prediction("generated_stance").alias("p"))


@query("unmatched_rate", GV + f""", s AS (SELECT target, {_dict_sql('generated_text')} AS st FROM generation_view)
SELECT target, count(*) AS n_rows, count(*) FILTER (WHERE st = '') AS n_unmatched,
       round(avg(CASE WHEN st = '' THEN 1.0 ELSE 0.0 END), 6) AS unmatched_rate
FROM s GROUP BY target""")
def q_unmatched_rate(spark, sf):
    out = PL.parse_generations(generation_view(spark, sf), "dict")
    return rounded(PL.unmatched_rate(out, ["target"]))


@query("unknown_count", GV + f""", s AS (
  SELECT target, {_p2_sql(_chat_sql('generated_text'))} AS p FROM generation_view)
SELECT target, count(*) FILTER (WHERE p = -1) AS n_unknown, count(*) FILTER (WHERE p IS NULL) AS n_unmapped,
       count(*) AS n_rows
FROM s GROUP BY target""")
def q_unknown_count(spark, sf):
    out = PL.parse_generations(generation_view(spark, sf), "chat")
    return PL.unknown_count(out.withColumn("p", encode_prediction("generated_stance")), ["target"])


@query("generation_eval", GV + f""", s AS (
  SELECT target, y, {_p2_sql(_free_sql('generated_text'))} AS p FROM generation_view),
c AS (SELECT {class_counts()} FROM s),
t AS (SELECT target, {class_counts()} FROM s GROUP BY target)
SELECT 'overall' AS scope, 'avg2' AS name, round(({f1c(0)} + {f1c(2)}) / 2, 6) AS value FROM c
UNION ALL SELECT 'target', target, round(({f1c(0)} + {f1c(2)}) / 2, 6) FROM t""")
def q_generation_eval(spark, sf):
    """Entry 2 of the reference: parse free text, map, score per target."""
    out = PL.parse_generations(generation_view(spark, sf), "free")
    out = out.withColumn("p", encode_prediction("generated_stance"))
    return rounded(M.evaluate(out, "SemEval2016", per_target=True))
