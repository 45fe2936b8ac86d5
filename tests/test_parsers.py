"""The parser edge strings (FIXTURES.md section 4) in Spark and DuckDB,
and parity with Python's ``re`` written by us."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from stanceflow.functions.parse import CHAT_PATTERN_SQL, DICT_PATTERN, FREE_PATTERN, parse_chat, parse_dict, parse_free
from stanceflow.plans.views import PARSER_STRINGS

# expected (parse_dict, parse_chat, parse_free) per edge string
EXPECTED = [
    ("FAVOR", "FAVOR", "FAVOR"),
    ("AGAINST", "AGAINST", "AGAINST"),
    ("", "", "FAVOR"),
    ("", "FAVOR", "FAVOR"),
    ("", "NO\nSTANCE", "NONE"),
    ("", "NONE", "FAVOR"),
    ("", "NONE", "NONE"),
    ("", "", "FAVOR"),
    ("", "", "NONE"),
    ("", "FAVOR", "FAVOR"),
    ("", "NONE", "NONE"),
    ("", "NO\u00a0STANCE", "NONE"),
    ("", "", "NONE"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(PARSER_STRINGS)] + [(99, None)], "i int, t string")
    return {r["i"]: r for r in df.select("i", parse_dict("t").alias("d"), parse_chat("t").alias("c"),
                                         parse_free("t").alias("f")).collect()}


@pytest.mark.parametrize("i", range(len(PARSER_STRINGS)))
def test_edge_strings_spark(parsed, i):
    d, c, f = EXPECTED[i]
    assert (parsed[i]["d"], parsed[i]["c"], parsed[i]["f"]) == (d, c, f)


def test_null_text_gives_empty(parsed):
    assert (parsed[99]["d"], parsed[99]["c"], parsed[99]["f"]) == ("", "", "")


def _py_chat(t):
    m = re.search(r"\[\/INST\](.*?)(FAVOR|AGAINST|NONE|No\s?Stance|NEUTRAL)", t, re.DOTALL | re.IGNORECASE)
    if not m:
        return ""
    s = m.group(2).lower().replace("no stance", "NONE").lower().replace("nostance", "NONE")
    return s.lower().replace("neutral", "NONE").upper()


def _py_dict(t):
    m = re.search(r"\[\/INST\](.*?)(?=[\"]?Stance['\"]?: ['\"]?(FAVOR|AGAINST|NONE)['\"]?)", t, re.DOTALL)
    return m.group(2) if m else ""


def _py_free(t):
    m = re.search(r"(FAVOR|AGAINST|NONE)", t, re.IGNORECASE)
    return m.group(0).upper() if m else "NONE"


@pytest.mark.parametrize("i", range(len(PARSER_STRINGS)))
def test_python_re_parity(parsed, i):
    t = PARSER_STRINGS[i]
    assert parsed[i]["c"] == _py_chat(t)
    assert parsed[i]["d"] == _py_dict(t)
    assert parsed[i]["f"] == _py_free(t)


@pytest.mark.parametrize("i", range(11))
def test_duckdb_patterns_agree(parsed, i):
    t = PARSER_STRINGS[i]
    con = duckdb.connect()
    d, c, f = con.execute(
        "SELECT coalesce(regexp_extract(?, ?, 1), ''), coalesce(regexp_extract(?, ?, 1), ''), "
        "regexp_extract(?, ?, 1)", [t, DICT_PATTERN, t, CHAT_PATTERN_SQL, t, FREE_PATTERN]).fetchone()
    assert d == parsed[i]["d"]
    chat = "NONE" if c.lower() in ("no stance", "nostance", "neutral") else c.upper()
    assert chat == parsed[i]["c"]
    assert (f.upper() if f else "NONE") == parsed[i]["f"]


def test_parsers_run_whole_texts(spark):
    long = "[/INST] " + "x " * 50000 + "Stance: AGAINST"
    r = spark.createDataFrame([(long,)], "t string").select(parse_dict("t").alias("d"),
                                                            F.length("t").alias("n")).first()
    assert r["d"] == "AGAINST" and r["n"] == len(long)
