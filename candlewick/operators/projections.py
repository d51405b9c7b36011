"""Projections, row filters and per-symbol limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.calendar import date_text
from candlewick.schema import FEATURES, OHLCV, present


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows with a missing value in ``subset`` (default: all columns) are dropped."""
    return df.na.drop(subset=list(subset) if subset else None)


def feature_projection(df: DataFrame, keys: Sequence[str] = ("symbol", "dt")) -> DataFrame:
    """Keys + the fixed feature list, only the columns present."""
    return df.select(*keys, *present(df, FEATURES))


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    """N6 + L2: the last ``n`` rows per symbol, date as text, OHLCV (+MA_20, RSI)."""
    w = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    tail = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    extra = present(df, ["ma_20", "rsi"])
    return tail.select("symbol", date_text(F.col("dt")).alias("date"), *OHLCV, *extra)


# Chart series in drawing order.
CHART_SERIES = ["close", "ma_20", "ma_50", "volume", "rsi"]


def chart_series(df: DataFrame) -> DataFrame:
    """Long (symbol, dt, series, value) table; a series with no value at
    all for a symbol is left out (an aggregation of the series that have
    values, then a semi-join: no task holds a whole symbol)."""
    cols = present(df, CHART_SERIES)
    long = df.select("symbol", "dt", *[F.col(c).cast("double") for c in cols]).unpivot(
        ["symbol", "dt"], cols, "series", "value")
    have = long.where(F.col("value").isNotNull()).select("symbol", "series").distinct()
    return long.join(have, ["symbol", "series"], "left_semi").select("symbol", "dt", "series", "value")


def sort_bars(df: DataFrame) -> DataFrame:
    """L1: output order (symbol, dt); windows carry their own order."""
    return df.orderBy("symbol", "dt")


def seeded_sample(df: DataFrame, n: int = 200, seed: int = 42, partition: Sequence[str] = ("symbol",)) -> DataFrame:
    """L4: up to ``n`` rows per symbol, chosen by ``md5(seed|symbol|dt)``.

    The order is a pure function of the row, so the sample is the same on
    any partitioning and in any engine; ``row_number() <= n`` lets Spark
    keep only ``n`` rows per symbol and map task before the shuffle.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in partition],
                            F.col("dt").cast("string")))
    w = Window.partitionBy(*partition).orderBy(key, "dt")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
