"""Training-data queries against their SQL twins."""

import oracle
import pytest

from refledger.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_equals_sql(spark, sf, name):
    assert oracle.compare(spark, oracle.connect(sf), name, QUERIES[name], ORACLES[name], sf) is None


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in QUERIES] and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
