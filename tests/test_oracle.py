"""Every registered query against its DuckDB SQL (small scale factor; the
driver repeats this at sf0.01, ``tools/oracle_check.py`` runs it locally)."""

import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from stanceflow.plans.queries import ORACLES, QUERIES  # noqa: E402

NO_SQL = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_duckdb(spark, con, key):
    status, n_spark, n_duck, _, msg = compare(spark, con, SF_SMALL, key, QUERIES[key], ORACLES[key])
    assert status == "OK", msg


def test_every_key_has_sql():
    assert NO_SQL == []


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["seed", "epoch", "target", "n_rows", "f1"]
