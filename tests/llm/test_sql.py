"""The numbered queries beside their SQL on whole tables."""

import pytest
from compare import both

from kinotable.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    got, want = both(spark, SF, queries.QUERIES[name], queries.ORACLES[name])
    assert got == want and want
