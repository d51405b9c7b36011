"""Ordered window operators per symbol.

Conventions, matching the reference's pandas semantics:

* a rolling statistic over ``k`` rows exists only when all ``k`` rows have a
  value (pandas ``rolling(k)`` default) -- :func:`full_window` gates it;
* divisions are ``try_divide`` and logarithms of non-positive numbers are
  NULL, so ANSI mode never raises and no +/-inf appears;
* RSI counts a missing first difference as zero gain and zero loss, and
  uses a plain rolling mean (not Wilder smoothing).

All window columns share one specification (``partitionBy(symbol)
.orderBy(dt)``), so the whole indicator table is one hash exchange on
``symbol`` plus one sort; Catalyst folds same-frame aggregates into a
single Window node.  The partition of a symbol holds one row per bar, so
its size is bounded by the calendar (``validate_bars`` guarantees one bar
per (symbol, dt)), not by the number of trades behind the bars.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlewick.schema import INDICATORS, LAGS, OHLCV

PARTITION = ("symbol",)


def series_window(partition: Sequence[str] = PARTITION, order: str = "dt") -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(order)


def full_window(fn: Callable[[Column], Column], col: str | Column, k: int, w: WindowSpec) -> Column:
    """``fn(col)`` over the last ``k`` rows, NULL unless all ``k`` rows have a value."""
    c = F.col(col) if isinstance(col, str) else col
    frame = w.rowsBetween(-(k - 1), Window.currentRow)
    return F.when(F.count(c).over(frame) == k, fn(c).over(frame))


def safe_ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def pct_change(c: Column, prev: Column) -> Column:
    return F.try_divide(c, prev) - F.lit(1.0)


# --- single operators -------------------------------------------------------

def with_diff(df: DataFrame, col: str = "close", out: str = "diff", w: WindowSpec | None = None) -> DataFrame:
    """First difference ``x - lag(x)``."""
    w = w or series_window()
    return df.withColumn(out, F.col(col) - F.lag(col, 1).over(w))


def with_pct_change(df: DataFrame, k: int = 1, col: str = "close", out: str | None = None,
                    w: WindowSpec | None = None) -> DataFrame:
    """``x / lag(x, k) - 1`` (NULL on a zero or missing base; no padding)."""
    w = w or series_window()
    return df.withColumn(out or f"pct_change_{k}", pct_change(F.col(col), F.lag(col, k).over(w)))


def with_log_return(df: DataFrame, col: str = "close", out: str = "log_return",
                    w: WindowSpec | None = None) -> DataFrame:
    """``ln(x) - ln(lag(x))``; NULL where either price is not positive."""
    w = w or series_window()
    lx = safe_ln(F.col(col))
    return df.withColumn(out, lx - F.lag(lx, 1).over(w))


def with_sma(df: DataFrame, k: int, col: str = "close", out: str | None = None,
             w: WindowSpec | None = None) -> DataFrame:
    """Simple moving average over a full window of ``k`` rows."""
    w = w or series_window()
    return df.withColumn(out or f"ma_{k}", full_window(F.avg, col, k, w))


def rsi_columns(df: DataFrame, col: str = "close", w: WindowSpec | None = None) -> DataFrame:
    """Stage ``_gain``/``_loss``; a missing first difference counts as 0."""
    w = w or series_window()
    c = F.col(col)
    delta = c - F.lag(c, 1).over(w)
    return df.withColumn("_gain", F.when(delta > 0, delta).otherwise(F.lit(0.0))).withColumn(
        "_loss", F.when(delta < 0, -delta).otherwise(F.lit(0.0))
    )


def rsi_expr(window: int, w: WindowSpec) -> Column:
    """RSI from staged ``_gain``/``_loss``: ``100*g/(g+l)``, NULL when both are 0."""
    g = full_window(F.avg, "_gain", window, w)
    loss = full_window(F.avg, "_loss", window, w)
    return F.lit(100.0) * F.try_divide(g, g + loss)


def with_rsi(df: DataFrame, window: int = 14, col: str = "close", out: str = "rsi",
             w: WindowSpec | None = None) -> DataFrame:
    """RSI with a plain rolling mean of gains and losses."""
    w = w or series_window()
    staged = rsi_columns(df, col, w)
    return staged.withColumn(out, rsi_expr(window, w)).drop("_gain", "_loss")


def with_rolling_vol(df: DataFrame, ks: Sequence[int] = (5, 20), col: str = "close",
                     w: WindowSpec | None = None) -> DataFrame:
    """Sample standard deviation of log returns over full windows."""
    w = w or series_window()
    lx = safe_ln(F.col(col))
    staged = df.withColumn("_lr", lx - F.lag(lx, 1).over(w))
    for k in ks:
        staged = staged.withColumn(f"vol_{k}", full_window(F.stddev_samp, "_lr", k, w))
    return staged.drop("_lr")


def with_momentum(df: DataFrame, k: int = 5, col: str = "close", w: WindowSpec | None = None) -> DataFrame:
    """Momentum: ``x / lag(x, k) - 1``."""
    return with_pct_change(df, k, col, f"mom_{k}", w)


def zscore_expr(k: int, col: str, w: WindowSpec) -> Column:
    """``(x - ma_k) / (std_k + 1e-9)`` over full windows."""
    ma = full_window(F.avg, col, k, w)
    sd = full_window(F.stddev_samp, col, k, w)
    return (F.col(col) - ma) / (sd + F.lit(1e-9))


def with_zscore(df: DataFrame, k: int = 20, col: str = "close", w: WindowSpec | None = None) -> DataFrame:
    w = w or series_window()
    return df.withColumn(f"z_{k}", zscore_expr(k, col, w))


def with_volume_ma(df: DataFrame, k: int = 10, w: WindowSpec | None = None) -> DataFrame:
    """Volume average over full windows (NULL for a symbol without volume)."""
    w = w or series_window()
    return df.withColumn("volume_ma", full_window(F.avg, "volume", k, w))


def with_lags(df: DataFrame, lags: Sequence[int] = LAGS, col: str = "close", w: WindowSpec | None = None) -> DataFrame:
    """``close_lag_i`` and ``ret_lag_i`` (lagged one-row percent change)."""
    w = w or series_window()
    staged = df.withColumn("_pc", pct_change(F.col(col), F.lag(col, 1).over(w)))
    cols = []
    for i in lags:
        cols += [F.lag(col, i).over(w).alias(f"close_lag_{i}"), F.lag("_pc", i).over(w).alias(f"ret_lag_{i}")]
    return staged.select("*", *cols).drop("_pc")


def with_forward_targets(df: DataFrame, col: str = "close", w: WindowSpec | None = None) -> DataFrame:
    """Next-row percent return x100 and next-row price."""
    w = w or series_window()
    nxt = F.lead(col, 1).over(w)
    return df.withColumn("fwd_return_1d", pct_change(nxt, F.col(col)) * F.lit(100.0)).withColumn(
        "fwd_price_1d", nxt
    )


# --- the full indicator table -----------------------------------------------

def indicator_columns(df: DataFrame, w: WindowSpec | None = None) -> DataFrame:
    """All W1-W10 columns in two projections that share one window spec.

    Stage 1 holds the per-row lags (difference, returns, log return);
    stage 2 the rolling aggregates over them.  Both stages run over the
    same partitioning and sort order, so the plan has one Exchange.
    """
    w = w or series_window()
    c = F.col("close")
    prev = F.lag(c, 1).over(w)
    delta = c - prev
    lc = safe_ln(c)
    s1 = df.select(
        "*",
        F.when(delta > 0, delta).otherwise(F.lit(0.0)).alias("_gain"),
        F.when(delta < 0, -delta).otherwise(F.lit(0.0)).alias("_loss"),
        pct_change(c, prev).alias("price_change"),
        (lc - F.lag(lc, 1).over(w)).alias("log_return"),
        pct_change(c, F.lag(c, 5).over(w)).alias("mom_5"),
        F.lead(c, 1).over(w).alias("fwd_price_1d"),
    )
    s2 = s1.select(
        *df.columns,
        "price_change",
        "log_return",
        "mom_5",
        "fwd_price_1d",
        full_window(F.avg, "close", 20, w).alias("ma_20"),
        full_window(F.stddev_samp, "close", 20, w).alias("_sd20"),
        full_window(F.avg, "close", 50, w).alias("ma_50"),
        full_window(F.avg, "_gain", 14, w).alias("_g"),
        full_window(F.avg, "_loss", 14, w).alias("_l"),
        full_window(F.stddev_samp, "log_return", 5, w).alias("vol_5"),
        full_window(F.stddev_samp, "log_return", 20, w).alias("vol_20"),
        full_window(F.avg, "volume", 10, w).alias("volume_ma"),
        *[x for i in LAGS for x in (F.lag("close", i).over(w).alias(f"close_lag_{i}"),
                                    F.lag("price_change", i).over(w).alias(f"ret_lag_{i}"))],
        (F.lead("price_change", 1).over(w) * F.lit(100.0)).alias("fwd_return_1d"),
    )
    s2 = s2.withColumn("rsi", F.lit(100.0) * F.try_divide(F.col("_g"), F.col("_g") + F.col("_l"))).withColumn(
        "z_20", (F.col("close") - F.col("ma_20")) / (F.col("_sd20") + F.lit(1e-9))
    )
    return s2.select(*df.columns, *INDICATORS)


def complete_subset(columns: Sequence[str], drop_incomplete: bool = True, require_volume: bool = True) -> list[str]:
    """Columns that must be non-NULL for a row to survive N4."""
    keep = ["dt", *OHLCV, *INDICATORS]
    if not require_volume:
        keep = [c for c in keep if c not in ("volume", "volume_ma")]
    if not drop_incomplete:
        keep = [c for c in keep if c not in ("fwd_return_1d", "fwd_price_1d")]
    have = set(columns)
    return [c for c in keep if c in have]


def indicator_table(bars: DataFrame, drop_incomplete: bool = True, require_volume: bool = True,
                    w: WindowSpec | None = None, segment_rows: int | None = None) -> DataFrame:
    """Bars + the 20 indicator columns, rows with a missing value dropped.

    ``drop_incomplete=True`` also drops the last bar (no forward target) as
    the reference does; ``False`` keeps it for inference.
    ``require_volume=False`` keeps symbols that have no volume.
    ``segment_rows`` splits every symbol into tasks of at most that many
    rows (plus a halo), for series too long for one task; results are equal.
    """
    base = bars.where(F.col("dt").isNotNull()).select("symbol", "dt", *OHLCV)
    if segment_rows:
        from candlewick.operators import segments as seg

        s = seg.segment(seg.with_positions(base), segment_rows)
        ind = indicator_columns(s, seg.segment_window()).where(~F.col("_halo"))
        ind = ind.select("symbol", "dt", *OHLCV, *INDICATORS)
    else:
        ind = indicator_columns(base, w)
    return ind.na.drop(subset=complete_subset(ind.columns, drop_incomplete, require_volume))


def latest_change(df: DataFrame, col: str = "close") -> DataFrame:
    """Latest value per symbol and its change against the previous row.

    ``row_number() <= 2`` lets Spark plan a WindowGroupLimit: each map task
    keeps only its two latest rows per symbol before the shuffle.
    """
    w = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    top2 = df.select("symbol", "dt", F.col(col).alias("v"), F.row_number().over(w).alias("_rn")).where(
        F.col("_rn") <= 2
    )
    g = top2.groupBy("symbol").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("dt"))).alias("dt"),
        F.max(F.when(F.col("_rn") == 1, F.col("v"))).alias("last"),
        F.max(F.when(F.col("_rn") == 2, F.col("v"))).alias("prev"),
    )
    change = F.coalesce(F.col("last") - F.col("prev"), F.lit(0.0))
    pct = F.coalesce(F.try_divide(F.col("last") - F.col("prev"), F.col("prev")) * F.lit(100.0), F.lit(0.0))
    return g.select("symbol", "dt", "last", "prev", change.alias("change"), pct.alias("change_pct"))


def top_k(df: DataFrame, partition: Sequence[str], order: Column, k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows per partition by ``order`` (ties broken by all columns given)."""
    w = Window.partitionBy(*partition).orderBy(order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


__all__ = [
    "series_window", "full_window", "with_diff", "with_pct_change", "with_log_return",
    "with_sma", "with_rsi", "with_rolling_vol", "with_momentum", "with_zscore", "with_volume_ma",
    "with_lags", "with_forward_targets", "indicator_columns", "indicator_table", "latest_change", "top_k",
]
