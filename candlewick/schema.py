"""Bar schema, feature lists and the bar validity check.

A bar table has one row per (symbol, dt).  ``dt`` is a DATE for daily bars
(a TIMESTAMP works for intraday bars: every window only orders by it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["symbol", "dt"]
OHLCV = ["open", "high", "low", "close", "volume"]
BAR_COLUMNS = KEY + OHLCV + ["source"]

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("dt", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

# Indicator columns in the order the reference adds them.
INDICATORS = [
    "ma_20", "ma_50", "rsi", "price_change", "log_return", "vol_5", "vol_20",
    "mom_5", "z_20", "volume_ma",
    "close_lag_1", "ret_lag_1", "close_lag_2", "ret_lag_2",
    "close_lag_3", "ret_lag_3", "close_lag_5", "ret_lag_5",
    "fwd_return_1d", "fwd_price_1d",
]
LAGS = [1, 2, 3, 5]

# The 22 model features in the reference's order
# (14 fixed columns, then close/return lag pairs for lags 1, 2, 3, 5).
FEATURES = [
    "open", "high", "low", "volume", "ma_20", "ma_50", "rsi", "price_change",
    "log_return", "vol_5", "vol_20", "mom_5", "z_20", "volume_ma",
    "close_lag_1", "ret_lag_1", "close_lag_2", "ret_lag_2",
    "close_lag_3", "ret_lag_3", "close_lag_5", "ret_lag_5",
]

# Longest look-back of any feature (MA_50) and rows needed for the
# iterative forecast state.
MAX_LOOKBACK = 50


def present(df: DataFrame, names: list[str]) -> list[str]:
    """Names from ``names`` that exist in ``df`` (order of ``names``)."""
    have = set(df.columns)
    return [c for c in names if c in have]


def to_bars(df: DataFrame, source: str | Column | None = None) -> DataFrame:
    """Project any frame with the bar columns onto the declared bar schema."""
    src = df["source"] if source is None and "source" in df.columns else (
        source if isinstance(source, Column) else F.lit(source)
    )
    return df.select(
        F.col("symbol").cast("string").alias("symbol"),
        F.col("dt"),
        *[F.col(c).cast("double").alias(c) for c in OHLCV],
        src.cast("string").alias("source"),
    )


def duplicate_keys(bars: DataFrame) -> DataFrame:
    """(symbol, dt, n) for every key that occurs more than once."""
    return bars.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def validate_bars(bars: DataFrame) -> DataFrame:
    """Fail on a repeated (symbol, dt): ordered windows would be ambiguous.

    Runs one aggregation (partial aggregation before the shuffle, so a hot
    symbol costs no more than a cold one) and returns ``bars`` unchanged.
    """
    dup = duplicate_keys(bars).limit(5).collect()
    if dup:
        shown = ", ".join(f"{r['symbol']}@{r['dt']}x{r['n']}" for r in dup)
        raise ValueError(f"repeated (symbol, dt) in bars: {shown}")
    return bars
