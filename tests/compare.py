"""Comparing a query with its SQL, whatever the order of rows and columns."""

from collections import Counter
from decimal import Decimal


def canonical(value):
    if isinstance(value, (float, Decimal)):
        return float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def assert_same(frame, result):
    assert sorted(frame.columns) == sorted(result.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(result.columns, result.fetchall())
