import pytest

from tests.test_catalogue import compare
from veritree.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    compare(spark, sf, queries.queries()[name], queries.oracle_sql()[name])
