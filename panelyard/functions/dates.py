"""Date parsing and arithmetic. Text that is no date becomes NULL, as in the tolerant parsers replaced here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelyard.functions.numeric import ColumnOrName, as_column


def parse_mdy(x: ColumnOrName, pattern: str = "MM-dd-yyyy") -> Column:
    return F.try_to_date(as_column(x), pattern)


def parse_ymd(x: ColumnOrName, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(as_column(x), pattern)


def parse_compact(x: ColumnOrName) -> Column:
    """20200131, as a number or as text."""
    return F.try_to_date(as_column(x).cast("string"), "yyyyMMdd")


def format_date(x: ColumnOrName, pattern: str = "MM-dd-yyyy") -> Column:
    return F.date_format(as_column(x), pattern)


def shift_days(x: ColumnOrName, days: ColumnOrName | int) -> Column:
    return F.date_add(as_column(x), F.lit(days) if isinstance(days, int) else as_column(days))


def days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    return F.datediff(as_column(end), as_column(start))


def days_since(x: ColumnOrName, origin: str) -> Column:
    """Signed days since a fixed ISO date."""
    return F.datediff(as_column(x), F.lit(origin).cast("date"))
