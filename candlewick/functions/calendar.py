"""Business-day calendar and date text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday0(d: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return (F.dayofweek(d) + F.lit(5)) % F.lit(7)


def next_business_day(d: Column) -> Column:
    """the next day that is not Saturday or Sunday (no holidays)."""
    wd = weekday0(d)
    return F.date_add(d, F.when(wd == 4, 3).when(wd == 5, 2).otherwise(1))


def business_days_after(d: Column, n: Column | int) -> Column:
    """The ``n``-th business day after ``d`` (``n`` >= 1), in closed form.

    A weekend start counts from the Friday before; then every 5 business
    days add a weekend of 2 days.
    """
    n = F.lit(n) if isinstance(n, int) else n
    wd = weekday0(d)
    back = F.when(wd > 4, wd - F.lit(4)).otherwise(F.lit(0))
    fri = F.date_sub(d, back)
    w = wd - back
    days = n + F.lit(2) * F.floor((w + n) / F.lit(5)).cast("int")
    return F.date_add(fri, days.cast("int"))


def date_text(d: Column) -> Column:
    """``yyyy-MM-dd``."""
    return F.date_format(d, "yyyy-MM-dd")
