"""Registered queries against their SQL: every one on the smallest test folder, with ``WAYMARK_ALL=1`` on the next."""

import os
from pathlib import Path

import pytest

from checks import ORACLES, QUERIES
from run_checks import compare, database

FOLDER = "/root/testdata/sf0.01" if os.environ.get("WAYMARK_ALL") else "/root/testdata/sf0.001"

#: A polygon needs all its twelve corners, which the smallest tables do not have.
LARGER = {"d30_flow_lines": "/root/testdata/sf0.01"}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def databases():
    return {f: database(f) for f in {FOLDER, *LARGER.values()}}


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, databases, name):
    folder = LARGER.get(name, FOLDER)
    assert compare(QUERIES[name](spark, folder), databases[folder], ORACLES[name]).startswith("ok")


def test_every_query_is_registered_once():
    assert set(ORACLES) == set(QUERIES)
