"""Queries of the subpackage against their SQL, and the rest for their shape."""

import pytest

from minegrove.llm.queries import QUERIES, SQL

from ..compare import assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, duck, data):
    assert_same(QUERIES[name](spark, data), duck.sql(SQL[name]))


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("p6_ids", ["doc_id", "ids"]),
        ("p7_found", ["doc_id", "item_id"]),
        ("p8_found", ["doc_id", "sent_start", "sent_end"]),
    ],
)
def test_columns(name, columns, spark, data):
    frame = QUERIES[name](spark, data)
    assert frame.columns == columns
    assert frame.count() > 0
