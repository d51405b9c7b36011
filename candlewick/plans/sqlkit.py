"""DuckDB statement fragments for the oracle: the same semantics written as SQL.

Each fragment is a CTE body; oracle statements compose them with WITH.
Nothing here is executed by Spark.
"""

from __future__ import annotations

from candlewick.schema import INDICATORS, OHLCV

BARS = """
SELECT symbol, dt,
       arg_min(price, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS open,
       max(price) AS high,
       min(price) AS low,
       arg_max(price, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close,
       sum(l_quantity) AS volume,
       'lineitem' AS source
FROM (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS dt,
         CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS price,
         l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem
) t
WHERE symbol IS NOT NULL AND dt IS NOT NULL AND price IS NOT NULL
GROUP BY symbol, dt
"""

EVENT_BARS = """
SELECT symbol, dt,
       arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, (ts, event_id)) AS close, sum(1.0) AS volume, 'events' AS source
FROM (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS dt, value AS price, ts, event_id
      FROM events) t
WHERE symbol IS NOT NULL AND dt IS NOT NULL AND price IS NOT NULL
GROUP BY symbol, dt
"""

ORDER_BARS = """
SELECT symbol, dt,
       arg_min(price, o_orderkey) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, o_orderkey) AS close, sum(1.0) AS volume, 'orders' AS source
FROM (SELECT o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS dt, o_totalprice AS price, o_orderkey
      FROM orders) t
WHERE symbol IS NOT NULL AND dt IS NOT NULL AND price IS NOT NULL
GROUP BY symbol, dt
"""

W = "(PARTITION BY symbol ORDER BY dt)"


def frame(k: int) -> str:
    return f"(PARTITION BY symbol ORDER BY dt ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def full(fn: str, col: str, k: int) -> str:
    return f"CASE WHEN count({col}) OVER {frame(k)} = {k} THEN {fn}({col}) OVER {frame(k)} END"


def pct(num: str, den: str) -> str:
    return f"(CASE WHEN {den} <> 0 THEN {num} / {den} END - 1.0)"


def ln(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


def indicators_from(src: str) -> str:
    """Indicator columns (W1-W10) over the rows of ``src`` (needs symbol, dt, OHLCV)."""
    return f"""
SELECT *,
  100.0 * CASE WHEN _g + _l <> 0 THEN _g / (_g + _l) END AS rsi,
  (close - ma_20) / (_sd20 + 1e-9) AS z_20
FROM (
  SELECT symbol, dt, {", ".join(OHLCV)}, price_change, log_return, mom_5, fwd_price_1d,
    {full("avg", "close", 20)} AS ma_20,
    {full("stddev_samp", "close", 20)} AS _sd20,
    {full("avg", "close", 50)} AS ma_50,
    {full("avg", "_gain", 14)} AS _g,
    {full("avg", "_loss", 14)} AS _l,
    {full("stddev_samp", "log_return", 5)} AS vol_5,
    {full("stddev_samp", "log_return", 20)} AS vol_20,
    {full("avg", "volume", 10)} AS volume_ma,
    lag(close, 1) OVER {W} AS close_lag_1, lag(price_change, 1) OVER {W} AS ret_lag_1,
    lag(close, 2) OVER {W} AS close_lag_2, lag(price_change, 2) OVER {W} AS ret_lag_2,
    lag(close, 3) OVER {W} AS close_lag_3, lag(price_change, 3) OVER {W} AS ret_lag_3,
    lag(close, 5) OVER {W} AS close_lag_5, lag(price_change, 5) OVER {W} AS ret_lag_5,
    lead(price_change, 1) OVER {W} * 100.0 AS fwd_return_1d
  FROM (
    SELECT symbol, dt, {", ".join(OHLCV)},
      CASE WHEN close - lag(close) OVER {W} > 0 THEN close - lag(close) OVER {W} ELSE 0.0 END AS _gain,
      CASE WHEN close - lag(close) OVER {W} < 0 THEN lag(close) OVER {W} - close ELSE 0.0 END AS _loss,
      {pct("close", f"lag(close) OVER {W}")} AS price_change,
      {ln("close")} - lag({ln("close")}) OVER {W} AS log_return,
      {pct("close", f"lag(close, 5) OVER {W}")} AS mom_5,
      lead(close) OVER {W} AS fwd_price_1d
    FROM {src} WHERE dt IS NOT NULL
  ) s1
) s2
"""


def complete(cols: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


IND_COLUMNS = ["symbol", "dt", *OHLCV, *INDICATORS]
COMPLETE = complete(["dt", *OHLCV, *INDICATORS])
COMPLETE_NO_FWD = complete(["dt", *OHLCV, *[c for c in INDICATORS if not c.startswith("fwd_")]])


def base_ctes(bars_sql: str = BARS) -> str:
    """``bars``, ``ind_all`` (no rows dropped), ``ind`` (N4 applied) and
    ``ind_live`` (N4 without the forward targets)."""
    cols = ", ".join(IND_COLUMNS)
    return f"""
bars AS ({bars_sql}),
ind_all AS (SELECT {cols} FROM ({indicators_from("bars")}) x),
ind AS (SELECT * FROM ind_all WHERE {COMPLETE}),
ind_live AS (SELECT * FROM ind_all WHERE {COMPLETE_NO_FWD})
"""
