"""Every registered query against its independent DuckDB SQL (sf0.001 here; the driver uses sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck  # noqa: E402
from conftest import SF001  # noqa: E402

NAMES = sorted(E.queries())
#: checked against brute force in test_operators, or in tests/llm
WITHOUT_SQL = set(NAMES) - set(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_oracle_or_reason():
    # training-data operators that SQL can't express have brute-force tests of their own
    assert {n for n in WITHOUT_SQL if not n.startswith("op") and n != "pipeline"} <= {"detector_plugin"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "team_id" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    status, msg = compare(spark, con, name, SF001, E.queries(), E.oracle_sql())
    assert status == ("rows" if name in WITHOUT_SQL else "ok"), msg
