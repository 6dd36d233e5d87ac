"""Every query of the core against its SQL on the smallest tables."""

import pytest

from tests.compare import rows_of, rows_of_sql
from veritrail.plans import registries

QUERIES = {name: (query, registry.sql.get(name)) for registry in registries() for name, query in registry.queries.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, duck, name):
    query, sql = QUERIES[name]
    columns, rows = rows_of(query(spark, data))
    assert columns
    if sql is not None:
        assert (columns, rows) == rows_of_sql(duck, sql)
