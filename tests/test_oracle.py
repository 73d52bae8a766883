"""Every query against its SQL on the smallest test tables."""

import importlib
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import TESTDATA, compare, connect

SF_DIR = TESTDATA / "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


#: Queries that SQL can't express, or not in a time to wait for, and the tests that compare them with plain versions.
BRUTE_FORCE = {
    "a33_bootstrap_interval": "tests/test_resample.py::test_draws_equal_plain_sums_of_the_same_picks",
    "sc17_section_file_refs": "tests/test_semantics.py::test_plan_chunks",
    "sc18_section_brief": "tests/test_semantics.py::test_long_brief_is_cut_at_a_line",
}


def brute_force():
    found = dict(BRUTE_FORCE)
    try:
        found |= importlib.import_module("tests.llm.plain").BRUTE_FORCE
    except ModuleNotFoundError:  # the optional part is absent
        pass
    return found


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        path, _, test = brute_force()[name].partition("::")
        assert f"def {test}(" in Path(path).read_text(), f"{name} has neither SQL nor a test against a plain version"
    _, problem = compare(spark, con, name, queries()[name], sql, SF_DIR)
    assert problem is None, problem
