"""Identifiers and dates as they come in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is not part of an id.
ID_BLANKS = " \t\r\n"


def clean_id(column: str | Column) -> Column:
    """The id without surrounding blanks; null where nothing is left."""
    col = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.trim(col, F.lit(ID_BLANKS)), F.lit(""))


def leading_year(column: str | Column) -> Column:
    """The year in the first four characters; null where they are no four digits."""
    col = F.col(column) if isinstance(column, str) else column
    head = F.substring(col, 1, 4)
    return F.when(head.rlike("^[0-9]{4}$"), head.cast("bigint"))


def month_of(column: str | Column) -> Column:
    """``YYYY-MM`` of a timestamp, read as it stands, whatever the session's zone."""
    col = F.col(column) if isinstance(column, str) else column
    return F.substring(col.cast("string"), 1, 7)
