"""DuckDB twins of the derived views (used by the oracle SQL)."""

from __future__ import annotations


def lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


STANCE_VIEW = """stance_view AS (
  SELECT d.doc_id, d.text, d.lang AS target, concat_ws(' ', d.lang, d.source) AS target_text,
         CASE WHEN l.toxic = 1 THEN 'AGAINST' WHEN l.quality = 1 THEN 'FAVOR' ELSE 'NONE' END AS stance,
         CAST(CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS INTEGER) AS y
  FROM documents d JOIN labels l USING (doc_id))"""

GRID = """grid AS (
  SELECT CAST(s.seed AS INTEGER) AS seed, CAST(e.epoch AS INTEGER) AS epoch
  FROM range(1, 4) s(seed), range(1, 6) e(epoch))"""

PREDICTION_VIEW = """prediction_view AS (
  SELECT v.doc_id, v.target, v.y, g.seed, g.epoch,
         CAST(CASE WHEN (v.doc_id * 17 + g.seed * 3 + g.epoch * 11) % 10 = 9 THEN -1
                   WHEN (v.doc_id * 17 + g.seed * 3 + g.epoch * 11) % 10 < 3 + (g.epoch * 3) % 5 THEN v.y
                   ELSE (v.y + 1 + (v.doc_id + g.seed) % 2) % 3 END AS INTEGER) AS p
  FROM stance_view v, grid g)"""

LOGITS_VIEW = """logits_view AS (
  SELECT vec_id, list_transform(range(3), lambda c: list_sum(list_transform(range(c, len(embedding), 3),
           lambda i: CAST(embedding[i + 1] AS DOUBLE)))) AS logits, CAST(label % 3 AS INTEGER) AS y
  FROM embeddings)"""


def with_views(*parts: str) -> str:
    """WITH clause for the given view snippets, in dependency order."""
    return "WITH " + ",\n".join(parts) + "\n"


BASE = with_views(STANCE_VIEW, GRID, PREDICTION_VIEW)


def f1(tp: str, npred: str, ntrue: str) -> str:
    return (f"CASE WHEN ({npred}) + ({ntrue}) > 0 THEN 2.0::DOUBLE * ({tp}) / (({npred}) + ({ntrue})) "
            f"ELSE 0.0::DOUBLE END")


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN ({num})::DOUBLE / ({den}) ELSE 0.0::DOUBLE END"


def class_counts(y: str = "y", p: str = "p", classes=(0, 1, 2)) -> str:
    parts = ["count(*) AS n_rows", f"count(*) FILTER (WHERE {y} = {p}) AS n_correct"]
    for c in classes:
        k = f"m{-c}" if c < 0 else str(c)
        parts += [f"count(*) FILTER (WHERE {y} = {c} AND {p} = {c}) AS tp_{k}",
                  f"count(*) FILTER (WHERE {p} = {c}) AS np_{k}",
                  f"count(*) FILTER (WHERE {y} = {c}) AS ns_{k}"]
    return ", ".join(parts)


def f1c(c: int) -> str:
    k = f"m{-c}" if c < 0 else str(c)
    return f1(f"tp_{k}", f"np_{k}", f"ns_{k}")


# --- text cleaning twins --------------------------------------------------
def sql_tokens(col: str) -> str:
    from stanceflow.functions.text import TOKEN_PATTERN
    return f"coalesce(regexp_extract_all({col}, {lit(TOKEN_PATTERN)}, 0), []::VARCHAR[])"


def sql_lower(toks: str) -> str:
    return f"list_transform({toks}, lambda t: lower(t))"


def sql_split_words(s: str) -> str:
    return f"list_filter(string_split_regex({s}, '\\s+'), lambda w: w <> '')"


def sql_normalize(toks: str, pairs) -> str:
    items = list(pairs)
    if not items:
        return toks
    branches = " ".join(f"WHEN t = {lit(k)} THEN {sql_split_words(lit(v))}" for k, v in items)
    return f"flatten(list_transform({toks}, lambda t: CASE {branches} ELSE [t] END))"


def sql_clean_stance(col: str, pairs=()) -> str:
    from stanceflow.functions.text import EMOJI_PATTERN, MARKER_TAGS, URL_PATTERN
    s = f"regexp_replace(regexp_replace({col}, {lit(URL_PATTERN)}, '', 'g'), {lit(EMOJI_PATTERN)}, '', 'g')"
    # whole words RT and FAV; without look-around each match takes its borders
    # along, so a second pass finds words that shared one
    word = r"(^|[^\p{L}\p{N}_])(?:RT|FAV)($|[^\p{L}\p{N}_])"
    for _ in range(2):
        s = f"regexp_replace({s}, {lit(word)}, '\\1\\2', 'g')"
    for t in MARKER_TAGS:
        s = f"replace({s}, {lit(t)}, '')"
    return sql_normalize(sql_lower(sql_tokens(s)), pairs)


def sql_clean_aspect(col: str) -> str:
    return sql_lower(sql_tokens(col))
