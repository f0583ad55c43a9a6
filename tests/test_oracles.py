"""Every query with a SQL check agrees with it on the smallest tables; every other one gives rows."""

import pytest

from carefold.plans.registry import all_oracles, all_queries
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()
SLOW = {"fs_19", "tun_03", "job_11", "fs_14", "tun_04"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    diff = [d for d in differences(QUERIES[name](spark, FOLDER), con, ORACLES[name]) if d != "EMPTY"]
    assert diff == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_gives_rows(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
