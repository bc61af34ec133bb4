import pytest

from kestrane.llm.queries import queries
from kestrane.llm.sql import oracle_sql

from .. import oracle


@pytest.mark.parametrize("name", oracle_sql())
def test_query_equals_its_sql(name, spark, sf_dir):
    assert oracle.of_spark(queries()[name](spark, sf_dir)) == oracle.of_sql(oracle.connect(sf_dir), oracle_sql()[name])
