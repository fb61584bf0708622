"""Every registered query runs; those with an SQL twin give equal rows."""

import oracle
import pytest

from refledger.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", list(ORACLES))
def test_equals_sql(spark, con, sf, name):
    assert oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], sf) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
