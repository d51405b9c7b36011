"""Threshold grades and price/return conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and labels used by the reference.
RSI_OVERBOUGHT, RSI_OVERSOLD = 70.0, 30.0
SIGNAL_STRONG, SIGNAL_NEUTRAL_FLOOR = 2.0, -2.0
R2_EXCELLENT, R2_GOOD, R2_MODERATE = 0.8, 0.6, 0.4


def _number(c: Column) -> Column:
    """NaN -> NULL: Spark orders NaN above every number, so it would grade as the top class."""
    return F.when(~F.isnan(c), c)


def rsi_state(rsi: Column) -> Column:
    """overbought above 70, oversold below 30, else neutral (NULL and NaN give NULL)."""
    rsi = _number(rsi)
    return (F.when(rsi.isNull(), F.lit(None).cast("string"))
            .when(rsi > RSI_OVERBOUGHT, F.lit("overbought"))
            .when(rsi < RSI_OVERSOLD, F.lit("oversold"))
            .otherwise(F.lit("neutral")))


def signal(pct: Column) -> Column:
    """strong bullish > 2 %, mild bullish > 0, neutral > -2 %, else bearish (NULL and NaN give NULL)."""
    pct = _number(pct)
    return (F.when(pct.isNull(), F.lit(None).cast("string"))
            .when(pct > SIGNAL_STRONG, F.lit("strong bullish"))
            .when(pct > 0, F.lit("mild bullish"))
            .when(pct > SIGNAL_NEUTRAL_FLOOR, F.lit("neutral"))
            .otherwise(F.lit("bearish")))


def r2_grade(r2: Column) -> Column:
    """excellent > 0.8, good > 0.6, moderate > 0.4, else poor (NULL and NaN count as poor)."""
    r2 = _number(r2)
    return (F.when(r2 > R2_EXCELLENT, F.lit("excellent"))
            .when(r2 > R2_GOOD, F.lit("good"))
            .when(r2 > R2_MODERATE, F.lit("moderate"))
            .otherwise(F.lit("poor")))


def price_from_return(price: Column, ret_pct: Column) -> Column:
    """``p * (1 + r/100)``."""
    return price * (F.lit(1.0) + ret_pct / F.lit(100.0))


def change_pct(new: Column, old: Column) -> Column:
    """percent change; 0 when the old price is 0, NULL when either price is missing."""
    return F.when(new.isNotNull() & (old == 0), F.lit(0.0)).otherwise(F.try_divide(new - old, old) * F.lit(100.0))
