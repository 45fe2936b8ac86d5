"""Parsers of generated text as column expressions (L1-L3).

Each parser is one ``regexp_extract`` plus a CASE; they run on the JVM
inside whole-stage codegen, over whole generated texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label alternatives each parser looks for.
FREE_PATTERN = r"(?i)(FAVOR|AGAINST|NONE)"
# after the first [/INST], across lines: Stance with optional quotes and
# exactly one space after the colon; upper-case labels only
DICT_PATTERN = r"""(?s)\[/INST\].*?"?Stance['"]?: ['"]?(FAVOR|AGAINST|NONE)"""
# after the first [/INST], any case; the no-stance spellings map to NONE
CHAT_PATTERN = r"(?is)\[/INST\].*?(FAVOR|AGAINST|NONE|No(?U:\s)?Stance|NEUTRAL)"
CHAT_PATTERN_SQL = r"(?is)\[/INST\].*?(FAVOR|AGAINST|NONE|No\s?Stance|NEUTRAL)"
NONE_SPELLINGS = ("no stance", "nostance", "neutral")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_free(c) -> Column:
    """L1: the first FAVOR / AGAINST / NONE anywhere, any case, inside words
    too; no match -> NONE; missing text -> ''."""
    m = F.regexp_extract(_col(c), FREE_PATTERN, 1)
    return F.when(_col(c).isNull(), F.lit("")).when(m == "", F.lit("NONE")).otherwise(F.upper(m))


def parse_dict(c) -> Column:
    """L2: zero-shot dictionary answer; no match or missing text -> ''."""
    return F.coalesce(F.regexp_extract(_col(c), DICT_PATTERN, 1), F.lit(""))


def parse_chat(c) -> Column:
    """L3: five-shot answer; 'No Stance', 'NoStance' and 'Neutral' (any case)
    become NONE, other spellings of no-stance stay raw (upper-cased)."""
    m = F.coalesce(F.regexp_extract(_col(c), CHAT_PATTERN, 1), F.lit(""))
    return F.when(F.lower(m).isin(*NONE_SPELLINGS), F.lit("NONE")).otherwise(F.upper(m))
