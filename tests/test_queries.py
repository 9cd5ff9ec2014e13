"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

from tests.oracle import connect, differences
from tidemark.plans import oracles, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: No SQL searches cycles of ten modules; tests/test_graph.py holds the query against brute force.
WITHOUT_SQL = {"bounded_cycles"}


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) - WITHOUT_SQL == set(oracles.ORACLES)


@pytest.mark.parametrize("name", [q for q in registry.QUERIES if q not in WITHOUT_SQL])
def test_query_equals_oracle(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF), con, oracles.ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
