"""Every query of graph retrieval against its SQL; what SQL doesn't state, by its properties."""

import pytest

from tests.oracle import SF_DIR, assert_alike
from walkrank.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, name):
    assert_alike(catalogue.queries()[name](spark, SF_DIR), SQL[name], SF_DIR)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_repeats_itself(spark, name):
    rows = [sorted(map(str, catalogue.queries()[name](spark, SF_DIR).collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]
