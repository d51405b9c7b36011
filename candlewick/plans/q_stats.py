"""Queries for statistics, projections, grades and calendar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions import calendar as cal
from candlewick.functions.grades import rsi_state, signal
from candlewick.operators import projections as proj
from candlewick.operators import stats
from candlewick.operators.windows import indicator_table
from candlewick.plans.present import rounded
from candlewick.plans.gappy import GAPPY_SQL, gappy_bars
from candlewick.plans.registry import register
from candlewick.plans.sqlkit import IND_COLUMNS, base_ctes, pct
from candlewick.schema import OHLCV
from candlewick.sources.trades import lineitem_bars

W = "(PARTITION BY symbol ORDER BY dt)"
RET = f"""ret AS (SELECT *, lag(_r) OVER {W} AS _r_prev FROM (
  SELECT *, {pct('close', f'lag(close) OVER {W}')} AS _r FROM ind) a)"""


def _ind(spark, sf, **kw):
    return indicator_table(lineitem_bars(spark, sf), **kw)


def _missing_sql(cols):
    return "greatest(" + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)" for c in cols) + ")"


_CORR = ("CASE WHEN stddev_samp(CASE WHEN _r_prev IS NOT NULL THEN _r END) * "
         "stddev_samp(CASE WHEN _r IS NOT NULL THEN _r_prev END) <> 0 THEN "
         "covar_samp(CASE WHEN _r_prev IS NOT NULL THEN _r END, CASE WHEN _r IS NOT NULL THEN _r_prev END) / "
         "(stddev_samp(CASE WHEN _r_prev IS NOT NULL THEN _r END) * stddev_samp(CASE WHEN _r IS NOT NULL THEN _r_prev END)) END")

DIAG_SQL = f"""WITH {base_ctes()}, {RET},
agg AS (
  SELECT symbol, count(*) AS rows, CAST(datediff('day', min(dt), max(dt)) AS INTEGER) AS date_span_days,
    {_missing_sql([c for c in IND_COLUMNS if c != 'symbol'])} AS missing_max_pct,
    CASE WHEN count(*) > 2 THEN coalesce(var_samp(_r), 0.0) ELSE 0.0 END AS ret_var,
    CASE WHEN count(*) > 5 AND count(_r) > 2 THEN {_CORR} ELSE 0.0 END AS ret_autocorr_lag1
  FROM ret GROUP BY symbol),
scored AS (
  SELECT *, CASE WHEN ret_autocorr_lag1 IS NOT NULL THEN least(100.0, greatest(0.0, 50.0 * least(1.0, rows / 250.0)
            + 30.0 * (ret_autocorr_lag1 + 1.0) / 2.0 + 20.0 * exp(-5.0 * least(ret_var, 0.02)))) END AS predictability_score,
    array_to_string(list_filter([
      CASE WHEN rows < 120 THEN '{stats.WARN_SHORT}' END,
      CASE WHEN missing_max_pct > 0.05 THEN '{stats.WARN_MISSING}' END,
      CASE WHEN abs(ret_autocorr_lag1) < 0.02 THEN '{stats.WARN_WEAK_AC}' END,
      CASE WHEN ret_autocorr_lag1 IS NULL THEN '{stats.WARN_CONSTANT}' END], lambda x: x IS NOT NULL), ' | ') AS warnings
  FROM agg)
"""


def _diag(spark, sf):
    return stats.diagnostics(_ind(spark, sf))


@register("diagnostics", DIAG_SQL + """SELECT symbol, rows, date_span_days, round(missing_max_pct, 4) AS missing_max_pct,
  round(ret_var, 8) AS ret_var, round(ret_autocorr_lag1, 4) AS ret_autocorr_lag1,
  round(predictability_score, 4) AS predictability_score FROM scored""")
def q_diagnostics(spark, sf):
    """A1-A5: diagnostics and predictability score per symbol on the processed table."""
    d = _diag(spark, sf).drop("warnings")
    return rounded(d, exact=["ret_var"])


@register("warnings", DIAG_SQL + "SELECT symbol, warnings FROM scored")
def q_warnings(spark, sf):
    """Diagnostic warnings per symbol, joined into one text."""
    return _diag(spark, sf).select("symbol", F.array_join("warnings", " | ").alias("warnings"))


@register("volatility", f"""WITH {base_ctes()}, {RET}
SELECT symbol, round(CASE WHEN count(*) > 2 THEN stddev_samp(_r) * sqrt(252) END, 4) AS volatility FROM ret GROUP BY symbol""")
def q_volatility(spark, sf):
    """Annualised volatility per symbol."""
    return rounded(stats.volatility(_ind(spark, sf)))


@register("key_stats", f"""WITH {base_ctes()}
SELECT symbol, round(max(high), 8) AS period_high, round(min(low), 8) AS period_low, round(avg(volume), 4) AS avg_volume
FROM ind GROUP BY symbol""")
def q_key_stats(spark, sf):
    """Period high/low and mean volume."""
    return rounded(stats.key_stats(_ind(spark, sf)))


@register("table_stats", f"""WITH {base_ctes()}, {RET}
SELECT symbol, round(max(high), 8) AS highest, round(min(low), 8) AS lowest, round(avg(close), 4) AS average_close,
  round(max(high) - min(low), 4) AS price_range, round(avg(volume), 4) AS average_volume,
  round(max(volume), 8) AS max_volume, count(*) AS data_points, min(dt) AS first_date, max(dt) AS last_date,
  round(CASE WHEN count(*) > 2 THEN stddev_samp(_r) * sqrt(252) END, 4) AS volatility
FROM ret GROUP BY symbol""")
def q_table_stats(spark, sf):
    """Data-table statistics per symbol."""
    return rounded(stats.table_stats(_ind(spark, sf)))


@register("table_text", f"""WITH bars AS ({GAPPY_SQL}),
t AS (SELECT symbol, max(high) AS highest, min(low) AS lowest, max(volume) AS max_volume FROM bars GROUP BY symbol)
SELECT symbol, {", ".join(f"CASE WHEN {c} IS NULL THEN 'Data not available' ELSE printf('%.8f', round({c}, 8)) END AS {c}" for c in ("highest", "lowest", "max_volume"))} FROM t""")
def q_table_text(spark, sf):
    """Data-table statistics as text; symbols without volumes say so."""
    return stats.table_text(stats.table_stats(gappy_bars(spark, sf)), ["highest", "lowest", "max_volume"], digits=8)


_SERIES = ["ma_20", "ma_50", "rsi", "volume_ma", "vol_20"]


@register("has_values", f"""WITH {base_ctes(GAPPY_SQL)}
SELECT symbol, {", ".join(f"count({c}) > 0 AS has_{c}" for c in _SERIES)} FROM ind_all GROUP BY symbol""")
def q_has_values(spark, sf):
    """Whether each indicator series has any value per symbol (before N4)."""
    from candlewick.operators.windows import indicator_columns

    b = gappy_bars(spark, sf).select("symbol", "dt", *OHLCV)
    return stats.has_values(indicator_columns(b), _SERIES)


@register("preview50", f"""WITH {base_ctes()}
SELECT symbol, strftime(dt, '%Y-%m-%d') AS date, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low,
  round(close, 8) AS close, round(volume, 8) AS volume, round(ma_20, 4) AS ma_20, round(rsi, 4) AS rsi
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM ind) a WHERE rn <= 50""")
def q_preview50(spark, sf):
    """N6 + L2: the last 50 processed rows per symbol with the date as text."""
    return rounded(proj.preview(_ind(spark, sf), 50))


@register("chart_series", f"""WITH {base_ctes()},
long AS ({" UNION ALL ".join(f"SELECT symbol, dt, '{c}' AS series, {c} AS value FROM ind_live" for c in proj.CHART_SERIES)})
SELECT symbol, dt, series, round(value, 8) AS value FROM (
  SELECT *, count(value) OVER (PARTITION BY symbol, series) AS c FROM long) a WHERE c > 0""")
def q_chart_series(spark, sf):
    """Chart series in long form (processed rows incl. the latest bar)."""
    return rounded(proj.chart_series(_ind(spark, sf, drop_incomplete=False)), exact=["value"])


@register("rsi_state", f"""WITH {base_ctes()}
SELECT symbol, dt, round(rsi, 4) AS rsi,
  CASE WHEN rsi IS NULL THEN NULL WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_state
FROM ind""")
def q_rsi_state(spark, sf):
    """F9 on every processed row."""
    return rounded(_ind(spark, sf).select("symbol", "dt", "rsi", rsi_state(F.col("rsi")).alias("rsi_state")))


@register("signals", f"""WITH {base_ctes()}
SELECT symbol, dt, round(price_change * 100.0, 4) AS pct,
  CASE WHEN price_change IS NULL THEN NULL WHEN price_change * 100.0 > 2 THEN 'strong bullish'
       WHEN price_change * 100.0 > 0 THEN 'mild bullish' WHEN price_change * 100.0 > -2 THEN 'neutral'
       ELSE 'bearish' END AS signal
FROM ind""")
def q_signals(spark, sf):
    """F10 on each processed row's percent move."""
    pct_ = F.col("price_change") * F.lit(100.0)
    return rounded(_ind(spark, sf).select("symbol", "dt", pct_.alias("pct"), signal(pct_).alias("signal")))


@register("next_business_day", f"""WITH bars AS ({__import__('candlewick.plans.sqlkit', fromlist=['BARS']).BARS})
SELECT symbol, dt, dt + CAST(CASE isodow(dt) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER) AS next_bd,
  strftime(dt, '%Y-%m-%d') AS date_text FROM bars""")
def q_next_business_day(spark, sf):
    """F13 + F14 on every bar date."""
    b = lineitem_bars(spark, sf)
    return b.select("symbol", "dt", cal.next_business_day(F.col("dt")).alias("next_bd"),
                    cal.date_text(F.col("dt")).alias("date_text"))


@register("forecast_dates", f"""WITH {base_ctes()},
last AS (SELECT symbol, max(dt) AS last_dt FROM ind_live GROUP BY symbol),
steps AS (SELECT symbol, last_dt, CAST(s AS INTEGER) AS step,
  CASE WHEN isodow(last_dt) > 5 THEN isodow(last_dt) - 5 ELSE 0 END AS back FROM last, range(1, 31) r(s))
SELECT symbol, step, CAST(last_dt - CAST(back AS INTEGER)
  + CAST(step + 2 * floor(((isodow(last_dt) - 1 - back) + step) / 5) AS INTEGER) AS DATE) AS dt FROM steps""")
def q_forecast_dates(spark, sf):
    """The next 30 distinct business days after each symbol's latest bar."""
    last = _ind(spark, sf, drop_incomplete=False).groupBy("symbol").agg(F.max("dt").alias("last_dt"))
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(30))))
    return steps.select("symbol", "step", cal.business_days_after(F.col("last_dt"), F.col("step")).alias("dt"))


@register("history_status", f"""WITH {base_ctes(GAPPY_SQL)},
b AS (SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol),
p AS (SELECT symbol, count(*) AS processed FROM ind GROUP BY symbol)
SELECT symbol, bars, coalesce(processed, 0) AS processed,
  CASE WHEN coalesce(processed, 0) < 2 THEN 'insufficient_history' WHEN coalesce(processed, 0) - 1 < 6 THEN 'no_cv'
       WHEN bars < 50 THEN 'no_forecast' ELSE 'ok' END AS status
FROM b LEFT JOIN p USING (symbol)""")
def q_history_status(spark, sf):
    """History status of many symbols, some short or with gaps."""
    b = gappy_bars(spark, sf)
    return stats.history_status(b, indicator_table(b))
