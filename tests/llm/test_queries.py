"""Every query of the training-data problems against its SQL on the smallest tables."""

import pytest

from tests.compare import rows_of, rows_of_sql
from veritrail.llm import registry

COLUMNS = {
    "p1_found": {"record_a", "record_b"},
    "p5_found": {"record_id", "group_id"},
    "p6_found": {"batch_id", "record_id"},
    "p7_ids": {"doc_id", "ids"},
    "p8_found": {"doc_id", "item_id"},
    "p9_found": {"doc_id", "subject"},
}


@pytest.mark.parametrize("name", registry.queries)
def test_query(spark, data, duck, name):
    columns, rows = rows_of(registry.queries[name](spark, data))
    assert set(columns) == COLUMNS.get(name, set(columns))
    if name in registry.sql:
        assert (columns, rows) == rows_of_sql(duck, registry.sql[name])
