"""Per-symbol statistics: diagnostics, volatility, key and table stats.

Every statistic is one ``groupBy(symbol).agg(...)``: partial aggregation
runs before the shuffle, so a symbol with a third of all rows costs one
extra partial row per map task, nothing more.  Returns are the one-row
percent change over the rows of the input (the reference computes them on
the processed table), which needs one lag over ``(symbol, dt)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.operators.windows import pct_change, series_window

# Warning texts and thresholds of the diagnostics.
WARN_SHORT = "Very little history (<120 rows); models can be unstable."
WARN_MISSING = "Missing values >5%; consider different data source or period."
WARN_WEAK_AC = "Returns show weak autocorrelation; short-term forecasting will be hard."
WARN_CONSTANT = "Returns are constant; autocorrelation is undefined."
SHORT_ROWS, MISSING_LIMIT, WEAK_AC = 120, 0.05, 0.02
ANNUALISE = 252


def with_returns(df: DataFrame, col: str = "close", segment_rows: int | None = None) -> DataFrame:
    """Adds ``_r`` (row-to-row percent change) and ``_r_prev`` (its lag).

    ``segment_rows`` computes the lags over bounded segments with a two-row
    halo (see :mod:`candlewick.operators.segments`); results are equal.
    """
    if segment_rows:
        from candlewick.operators import segments as seg

        base = seg.segment(seg.with_positions(df), segment_rows, back=2, fwd=0)
        w = seg.segment_window()
        r = pct_change(F.col(col), F.lag(col, 1).over(w))
        out = base.withColumn("_r", r).withColumn("_r_prev", F.lag("_r", 1).over(w))
        return out.where(~F.col("_halo")).drop("_pos", "_n", "_seg", "_halo")
    w = series_window()
    r = pct_change(F.col(col), F.lag(col, 1).over(w))
    return df.withColumn("_r", r).withColumn("_r_prev", F.lag("_r", 1).over(w))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over pairs where both are present; NULL when a
    side is constant (Spark's ``corr`` would raise under ANSI)."""
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(xx, yy), F.stddev_samp(xx) * F.stddev_samp(yy))


def diagnostics(df: DataFrame, columns: Sequence[str] | None = None, segment_rows: int | None = None) -> DataFrame:
    """Rows, date span, max missing share, return variance, lag-1
    autocorrelation, predictability score and warnings, one row per symbol."""
    cols = [c for c in (columns or df.columns) if c != "symbol"]
    d = with_returns(df, segment_rows=segment_rows)
    n = F.count(F.lit(1))
    nr = F.count("_r")
    agg = d.groupBy("symbol").agg(
        n.alias("rows"),
        F.datediff(F.max("dt"), F.min("dt")).alias("date_span_days"),
        F.greatest(*[F.avg(F.col(c).isNull().cast("double")) for c in cols]).alias("missing_max_pct")
        if len(cols) > 1 else F.avg(F.col(cols[0]).isNull().cast("double")).alias("missing_max_pct"),
        F.when(n > 2, F.coalesce(F.var_samp("_r"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("ret_var"),
        F.when((n > 5) & (nr > 2), safe_corr(F.col("_r"), F.col("_r_prev")))
        .when((n > 5) & (nr <= 2), F.lit(0.0))
        .otherwise(F.lit(0.0)).alias("ret_autocorr_lag1"),
    )
    size = F.least(F.lit(1.0), F.col("rows") / F.lit(250.0))
    ac = (F.col("ret_autocorr_lag1") + F.lit(1.0)) / F.lit(2.0)
    noise = F.exp(F.lit(-5.0) * F.least(F.col("ret_var"), F.lit(0.02)))
    score = F.lit(50.0) * size + F.lit(30.0) * ac + F.lit(20.0) * noise
    # greatest/least skip NULLs: keep an undefined score NULL
    score = F.when(score.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)))
    warnings = F.filter(F.array(
        F.when(F.col("rows") < SHORT_ROWS, F.lit(WARN_SHORT)),
        F.when(F.col("missing_max_pct") > MISSING_LIMIT, F.lit(WARN_MISSING)),
        F.when(F.abs(F.col("ret_autocorr_lag1")) < WEAK_AC, F.lit(WARN_WEAK_AC)),
        F.when(F.col("ret_autocorr_lag1").isNull(), F.lit(WARN_CONSTANT)),
    ), lambda x: x.isNotNull())
    return agg.select(
        "symbol", "rows", "date_span_days", "missing_max_pct", "ret_var", "ret_autocorr_lag1",
        score.alias("predictability_score"), warnings.alias("warnings"),
    )


def volatility(df: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Annualised volatility ``stddev(returns) * sqrt(252)``; NULL for <= 2 rows."""
    d = with_returns(df, segment_rows=segment_rows)
    return d.groupBy("symbol").agg(
        F.when(F.count(F.lit(1)) > 2, F.stddev_samp("_r") * F.lit(ANNUALISE ** 0.5)).alias("volatility")
    )


def key_stats(df: DataFrame) -> DataFrame:
    """Period high, period low and mean volume per symbol."""
    return df.groupBy("symbol").agg(
        F.max("high").alias("period_high"), F.min("low").alias("period_low"), F.avg("volume").alias("avg_volume")
    )


def table_stats(df: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """The data-table statistics per symbol, NULL where a column has no value."""
    d = with_returns(df, segment_rows=segment_rows)
    n = F.count(F.lit(1))
    return d.groupBy("symbol").agg(
        F.max("high").alias("highest"),
        F.min("low").alias("lowest"),
        F.avg("close").alias("average_close"),
        (F.max("high") - F.min("low")).alias("price_range"),
        F.avg("volume").alias("average_volume"),
        F.max("volume").alias("max_volume"),
        n.alias("data_points"),
        F.min("dt").alias("first_date"),
        F.max("dt").alias("last_date"),
        F.when(n > 2, F.stddev_samp("_r") * F.lit(ANNUALISE ** 0.5)).alias("volatility"),
    )


# Fixed value: the text for a statistic without a value.
NO_DATA = "Data not available"


def table_text(table: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """The statistics as text with fixed decimals, or NO_DATA."""
    return table.select("symbol", *[F.when(F.col(c).isNull(), F.lit(NO_DATA)).otherwise(F.format_string(f"%.{digits}f", F.round(c, digits))).alias(c)
                                    for c in columns])


def has_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per symbol, whether each column has at least one value."""
    return df.groupBy("symbol").agg(*[(F.count(c) > 0).alias(f"has_{c}") for c in columns])


# Rows a symbol needs before it can be modelled / forecast.
MIN_PROCESSED_ROWS = 2          # the reference needs at least two supervised rows
MIN_BARS_FOR_STATE = 50         # iterative forecast state


def history_status(bars: DataFrame, ind: DataFrame, folds: int = 5) -> DataFrame:
    """Per symbol, bars, processed rows and a status instead of a
    failed job: ``insufficient_history`` (no processed rows), ``no_cv``
    (fewer than ``folds+2`` supervised rows), ``no_forecast`` (fewer than 50
    bars), else ``ok``."""
    b = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    p = ind.groupBy("symbol").agg(F.count(F.lit(1)).alias("processed"))
    j = b.join(p, "symbol", "left").na.fill({"processed": 0})
    status = (F.when(F.col("processed") < MIN_PROCESSED_ROWS, F.lit("insufficient_history"))
              .when(F.col("processed") - 1 < folds + 1, F.lit("no_cv"))
              .when(F.col("bars") < MIN_BARS_FOR_STATE, F.lit("no_forecast"))
              .otherwise(F.lit("ok")))
    return j.select("symbol", "bars", "processed", status.alias("status"))
