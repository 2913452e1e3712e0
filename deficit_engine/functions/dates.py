"""Date arithmetic with warehouse ``INTERVAL n YEAR`` semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_date(c) -> Column:
    return F.to_date(_col(c))


def add_years(c, years) -> Column:
    """``date + INTERVAL years YEAR``; Feb 29 moves to Feb 28 like the warehouses.

    ``years`` may be an int or a Column (per-row lookback).
    """
    months = years * 12 if isinstance(years, int) else (years * F.lit(12)).cast("int")
    return F.add_months(_col(c), months)


def completed_years(start, end) -> Column:
    """Whole years from ``start`` to ``end`` (age on a date) by calendar fields."""
    def ymd(c):
        return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)
    return F.floor((ymd(_col(end)) - ymd(_col(start))) / F.lit(10000)).cast("int")
