"""Look-back period and date-range filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Period code -> days; anything else counts as 365.
PERIOD_DAYS = {"1mo": 30, "3mo": 90, "6mo": 180, "1y": 365, "2y": 730, "5y": 1825}
DEFAULT_DAYS = 365


def period_days(period: str) -> int:
    """S6."""
    return PERIOD_DAYS.get(period, DEFAULT_DAYS)


def lookback(bars: DataFrame, period: str, as_of: Column | str) -> DataFrame:
    """Bars with ``dt >= as_of - days(period)``; with a literal ``as_of``
    the predicate reaches the Parquet scan."""
    start = F.date_sub(F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of, period_days(period))
    return bars.where(F.col("dt") >= start)


def lookbacks(bars: DataFrame, periods: Sequence[str], as_of: str) -> DataFrame:
    """S7 for several periods from one read: the bars of the longest period,
    each with every ``period`` that it lies in."""
    longest = max(periods, key=period_days)
    inside = F.array(*(F.when(F.col("dt") >= F.date_sub(F.lit(as_of).cast("date"), period_days(p)), F.lit(p)) for p in periods))
    return lookback(bars, longest, as_of).withColumn("period", F.explode(F.array_compact(inside)))
