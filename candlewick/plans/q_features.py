"""Queries for the feature core: bars, window operators, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.operators import windows as win
from candlewick.plans.present import rounded, sql_round
from candlewick.plans.registry import register
from candlewick.plans.sqlkit import BARS, EVENT_BARS, IND_COLUMNS, ORDER_BARS, base_ctes
from candlewick.schema import BAR_COLUMNS, OHLCV
from candlewick.sources.trades import event_bars, lineitem_bars, order_bars

BAR_DOUBLES = OHLCV


@register("bars", f"SELECT {sql_round(BAR_COLUMNS, doubles=BAR_DOUBLES)} FROM ({BARS}) b")
def q_bars(spark, sf):
    """Daily OHLCV bars from all lineitem trades."""
    return rounded(lineitem_bars(spark, sf))


@register("bars_events", f"SELECT {sql_round(BAR_COLUMNS, doubles=BAR_DOUBLES)} FROM ({EVENT_BARS}) b")
def q_bars_events(spark, sf):
    """Hourly bars from all events by event type."""
    return rounded(event_bars(spark, sf))


@register("bars_orders", f"SELECT {sql_round(BAR_COLUMNS, doubles=BAR_DOUBLES)} FROM ({ORDER_BARS}) b")
def q_bars_orders(spark, sf):
    """Daily bars from all orders by order status."""
    return rounded(order_bars(spark, sf))


IND_DOUBLES = [c for c in IND_COLUMNS if c not in ("symbol", "dt")]


@register("indicator_table", f"WITH {base_ctes()} SELECT {sql_round(IND_COLUMNS, doubles=IND_DOUBLES)} FROM ind")
def q_indicator_table(spark, sf):
    """Full indicator table (N4 applied, incomplete last bar dropped)."""
    return rounded(win.indicator_table(lineitem_bars(spark, sf)))


# --- single window operators (W1-W10) on all bars ---------------------------

def _bars_sql() -> str:
    return f"WITH bars AS ({BARS})"


W_SQL = "(PARTITION BY symbol ORDER BY dt)"


def _one(name: str, spark_fn, cols: list[str], sql_cols: str):
    body = sql_cols if " FROM " in sql_cols else f"{sql_cols} FROM bars"
    sql = f"{_bars_sql()} SELECT symbol, dt, {sql_round(cols)} FROM (SELECT symbol, dt, {body}) x"

    @register(name, sql)
    def q(spark, sf):
        out = spark_fn(lineitem_bars(spark, sf))
        return rounded(out.select("symbol", "dt", *cols))

    q.__doc__ = f"{name} over every bar of every symbol."
    return q


from candlewick.plans.sqlkit import full as _full, ln as _ln, pct as _pct  # noqa: E402

_one("diff", lambda b: win.with_diff(b), ["diff"], f"close - lag(close) OVER {W_SQL} AS diff")
_one("pct_change", lambda b: win.with_pct_change(b, 1, out="pct_change_1"), ["pct_change_1"],
     f"{_pct('close', f'lag(close) OVER {W_SQL}')} AS pct_change_1")
_one("log_return", lambda b: win.with_log_return(b), ["log_return"],
     f"{_ln('close')} - lag({_ln('close')}) OVER {W_SQL} AS log_return")
_one("sma", lambda b: win.with_sma(win.with_sma(b, 20), 50), ["ma_20", "ma_50"],
     f"{_full('avg', 'close', 20)} AS ma_20, {_full('avg', 'close', 50)} AS ma_50")
_one("rsi", lambda b: win.with_rsi(b), ["rsi"], f"""100.0 * CASE WHEN g + l <> 0 THEN g / (g + l) END AS rsi FROM (
  SELECT symbol, dt, {_full('avg', '_gain', 14)} AS g, {_full('avg', '_loss', 14)} AS l FROM (
    SELECT symbol, dt,
      CASE WHEN close - lag(close) OVER {W_SQL} > 0 THEN close - lag(close) OVER {W_SQL} ELSE 0.0 END AS _gain,
      CASE WHEN close - lag(close) OVER {W_SQL} < 0 THEN lag(close) OVER {W_SQL} - close ELSE 0.0 END AS _loss
    FROM bars) a) b""")
_one("rolling_vol", lambda b: win.with_rolling_vol(b), ["vol_5", "vol_20"],
     f"""{_full('stddev_samp', 'lr', 5)} AS vol_5, {_full('stddev_samp', 'lr', 20)} AS vol_20 FROM (
  SELECT symbol, dt, {_ln('close')} - lag({_ln('close')}) OVER {W_SQL} AS lr FROM bars) a""")
_one("momentum", lambda b: win.with_momentum(b), ["mom_5"],
     f"{_pct('close', f'lag(close, 5) OVER {W_SQL}')} AS mom_5")
_one("zscore", lambda b: win.with_zscore(b), ["z_20"],
     f"(close - {_full('avg', 'close', 20)}) / ({_full('stddev_samp', 'close', 20)} + 1e-9) AS z_20")
_one("volume_ma", lambda b: win.with_volume_ma(b), ["volume_ma"], f"{_full('avg', 'volume', 10)} AS volume_ma")
_LAG_COLS = [c for i in (1, 2, 3, 5) for c in (f"close_lag_{i}", f"ret_lag_{i}")]
_one("lags", lambda b: win.with_lags(b), _LAG_COLS, ", ".join(
    f"lag(close, {i}) OVER {W_SQL} AS close_lag_{i}, lag(pc, {i}) OVER {W_SQL} AS ret_lag_{i}" for i in (1, 2, 3, 5)
) + f" FROM (SELECT symbol, dt, close, {_pct('close', f'lag(close) OVER {W_SQL}')} AS pc FROM bars) a")
_one("forward_targets", lambda b: win.with_forward_targets(b), ["fwd_return_1d", "fwd_price_1d"],
     f"{_pct(f'lead(close) OVER {W_SQL}', 'close')} * 100.0 AS fwd_return_1d, lead(close) OVER {W_SQL} AS fwd_price_1d")


# --- tables built on the indicator table -------------------------------------

@register("indicator_table_events", f"WITH {base_ctes(EVENT_BARS)} SELECT {sql_round(IND_COLUMNS, doubles=IND_DOUBLES)} FROM ind")
def q_indicator_table_events(spark, sf):
    """W11 on the hourly event bars."""
    return rounded(win.indicator_table(event_bars(spark, sf)))


@register("indicator_table_orders", f"WITH {base_ctes(ORDER_BARS)} SELECT {sql_round(IND_COLUMNS, doubles=IND_DOUBLES)} FROM ind")
def q_indicator_table_orders(spark, sf):
    """W11 on the daily order bars."""
    return rounded(win.indicator_table(order_bars(spark, sf)))


@register("indicator_live", f"WITH {base_ctes()} SELECT {sql_round(IND_COLUMNS, doubles=IND_DOUBLES)} FROM ind_live")
def q_indicator_live(spark, sf):
    """W11 with ``drop_incomplete=False``: the latest bar is kept for inference."""
    return rounded(win.indicator_table(lineitem_bars(spark, sf), drop_incomplete=False))


@register("latest_change", f"""WITH {base_ctes()}
SELECT symbol, dt, round(last, 8) AS last, round(prev, 8) AS prev,
       round(coalesce(last - prev, 0.0), 8) AS change,
       round(coalesce(CASE WHEN prev <> 0 THEN (last - prev) / prev END * 100.0, 0.0), 4) AS change_pct
FROM (SELECT symbol, max(dt) FILTER (WHERE rn = 1) AS dt, max(close) FILTER (WHERE rn = 1) AS last,
             max(close) FILTER (WHERE rn = 2) AS prev
      FROM (SELECT symbol, dt, close, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM ind) a
      WHERE rn <= 2 GROUP BY symbol) b""")
def q_latest_change(spark, sf):
    """Latest close of the processed table and its change."""
    return rounded(win.latest_change(win.indicator_table(lineitem_bars(spark, sf))))


def flagship(spark, sf):
    """Latest live bar per symbol: close, MA_20, MA_50, RSI, RSI state and day change."""
    from pyspark.sql import Window

    from candlewick.functions.grades import change_pct, rsi_state

    ind = win.indicator_table(lineitem_bars(spark, sf), drop_incomplete=False)
    w = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    top = ind.select("symbol", "dt", "close", "ma_20", "ma_50", "rsi",
                     F.lead("close", 1).over(w).alias("prev_close"),
                     F.row_number().over(w).alias("_rn")).where(F.col("_rn") == 1)
    return rounded(top.select("symbol", "dt", "close", "ma_20", "ma_50", "rsi", rsi_state(F.col("rsi")).alias("rsi_state"),
                              (F.col("close") - F.col("prev_close")).alias("change"),
                              change_pct(F.col("close"), F.col("prev_close")).alias("change_pct")))


register("flagship", f"""WITH {base_ctes()}
SELECT symbol, dt, round(close, 8) AS close, round(ma_20, 4) AS ma_20, round(ma_50, 4) AS ma_50, round(rsi, 4) AS rsi,
  CASE WHEN rsi IS NULL THEN NULL WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_state,
  round(close - prev_close, 8) AS change,
  round(coalesce(CASE WHEN prev_close <> 0 THEN (close - prev_close) / prev_close END * 100.0, 0.0), 4) AS change_pct
FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY dt DESC) AS prev_close,
             row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM ind_live) a
WHERE rn = 1""")(flagship)


@register("indicator_table_segmented", f"WITH {base_ctes()} SELECT {sql_round(IND_COLUMNS, doubles=IND_DOUBLES)} FROM ind")
def q_indicator_table_segmented(spark, sf):
    """W11 with every symbol split into 1,000-row segments plus halo (hot-symbol plan)."""
    return rounded(win.indicator_table(lineitem_bars(spark, sf), segment_rows=1000))


# --- normalisation and projections (N1-N5) -----------------------------------

from candlewick.operators import projections as proj  # noqa: E402
from candlewick.sources import wide  # noqa: E402


def _raw_text(spark, sf):
    b = lineitem_bars(spark, sf)
    # dates of every 31st are unreadable; volumes are ten times the traded ones, so some need a separator
    date = F.when(F.dayofmonth("dt") == 31, F.concat(F.lit("31st of "), F.date_format("dt", "MM/yyyy"))).otherwise(F.date_format("dt", "yyyy-MM-dd"))
    raw = b.select(F.col("symbol").alias("Symbol"), date.alias("Date"),
                   F.col("open").cast("string").alias("Open"), F.col("high").cast("string").alias("Open2"),
                   F.col("high").cast("string").alias("High"), F.col("low").cast("string").alias("Low"),
                   F.col("close").cast("string").alias("Close"), F.col("low").cast("string").alias("Adj Close"),
                   F.format_number(F.col("volume") * 10, 1).alias("Volume"))
    # the provider repeats a column name: the second "Open" must lose
    return raw.toDF("Symbol", "Date", "Open", "Open", "High", "Low", "Close", "Adj Close", "Volume")


@register("normalise", f"""WITH bars AS ({BARS})
SELECT symbol, CASE WHEN day(dt) <> 31 THEN dt END AS dt, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close,
  round(CASE WHEN volume * 10 < 1000 THEN volume * 10 END, 8) AS volume, 'provider_a' AS source FROM bars""")
def q_normalise(spark, sf):
    """Wide text with a repeated ``Open``, both ``Close`` and ``Adj Close``,
    and volumes written with thousands separators (unparseable -> NULL)."""
    return rounded(wide.normalise_wide(_raw_text(spark, sf), "Symbol"))


@register("coerce", f"""WITH bars AS ({BARS})
SELECT symbol, count(*) AS rows, count(CASE WHEN volume * 10 < 1000 THEN volume END) AS volume_values,
  count(CASE WHEN day(dt) <> 31 THEN dt END) AS dates FROM bars GROUP BY symbol""")
def q_coerce(spark, sf):
    """Per symbol, how many dates and volumes survive coercion."""
    n = wide.normalise_wide(_raw_text(spark, sf), "Symbol")
    return n.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count("volume").alias("volume_values"),
                                   F.count("dt").alias("dates"))


@register("drop_missing", f"""WITH bars AS ({BARS})
SELECT {sql_round(BAR_COLUMNS, doubles=OHLCV)} FROM (SELECT * EXCLUDE (source, volume), volume * 10 AS volume, 'provider_a' AS source FROM bars) b
WHERE volume < 1000 AND day(dt) <> 31""")
def q_drop_missing(spark, sf):
    """Rows with any missing value dropped after coercion."""
    return rounded(proj.drop_missing(wide.normalise_wide(_raw_text(spark, sf), "Symbol")))


_FEAT_COLS = ["symbol", "dt", *__import__("candlewick.schema", fromlist=["FEATURES"]).FEATURES]


@register("feature_projection", f"WITH {base_ctes()} SELECT {sql_round(_FEAT_COLS, doubles=_FEAT_COLS[2:])} FROM ind")
def q_feature_projection(spark, sf):
    """Keys and the 22 model features of the processed table."""
    return rounded(proj.feature_projection(win.indicator_table(lineitem_bars(spark, sf))))
