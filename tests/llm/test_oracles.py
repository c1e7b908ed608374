"""The numbered queries against their SQL, on whole tables."""

import pytest

from tests.oracle import SF_DIR, assert_alike
from walkrank.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, name):
    assert_alike(queries.queries()[name](spark, SF_DIR), SQL[name], SF_DIR)
