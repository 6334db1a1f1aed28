"""Every query that has SQL, on the smallest tables."""

import pytest

from tests.oracle import SF, same
from warraq import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.take(1)
