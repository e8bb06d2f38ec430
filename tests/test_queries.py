"""Every query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import connect, difference

from emberline.queries import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert not difference(registry.QUERIES[name](spark, sf_dir), con, registry.SQL[name])


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
