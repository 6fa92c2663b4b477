"""Every query with SQL equals it on the smallest tables; every other one gives rows."""

import pytest
from harness import differences

from siltstone.plans import catalogue

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), ORACLE[name], sf) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
