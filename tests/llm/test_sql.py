"""Every operator's query against its SQL on the smallest tables."""

import pytest

from pagelake.llm import queries
from tests.test_queries import DATA, canon, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):  # noqa: F811
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert canon(got, columns) == canon(want, columns)
