"""Forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.operators import forecast as fc
from candlewick.operators import models as M
from candlewick.operators import supervised as sv
from candlewick.operators.windows import indicator_table
from candlewick.plans.gappy import GAPPY_SQL, gappy_bars
from candlewick.plans.present import rounded
from candlewick.plans.q_supervised import HOLD, sup_cte
from candlewick.plans.registry import register
from candlewick.plans.ridge_sql import predicted, ridge_ctes
from candlewick.plans.sqlkit import base_ctes
from candlewick.schema import FEATURES, LAGS
from candlewick.sources.trades import lineitem_bars


def _setup(spark, sf, target="return"):
    bars = lineitem_bars(spark, sf)
    ind = indicator_table(bars)
    sup = sv.supervised(ind, 1, target)
    return bars, ind, sup


def _one_step_sql(target):
    price = "pred" if target == "price" else "current_price * (1.0 + pred / 100.0)"
    return f"""WITH RECURSIVE {base_ctes()}, {sup_cte(1, target)}, trn AS (SELECT * FROM (SELECT *, {HOLD} AS role FROM sup) h WHERE role = 'train'),
newest AS (SELECT * FROM (SELECT *, close AS current_price, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM ind_live) a WHERE rn = 1),
{ridge_ctes("trn")}, {predicted("newest", "symbol, dt, current_price")},
nxt AS (SELECT symbol, dt, current_price, pred AS y_hat, {price} AS next_price FROM pred),
chg AS (SELECT *, next_price - current_price AS delta, CASE WHEN current_price = 0 THEN 0.0 ELSE (next_price - current_price) / current_price * 100.0 END AS pct FROM nxt)
SELECT symbol, dt, round(current_price, 4) AS current_price, round(y_hat, 4) AS y_hat, round(next_price, 4) AS next_price,
  round(delta, 4) AS delta, round(pct, 4) AS pct,
  CASE WHEN pct > 2 THEN 'strong bullish' WHEN pct > 0 THEN 'mild bullish' WHEN pct > -2 THEN 'neutral' WHEN pct IS NOT NULL THEN 'bearish' END AS signal
FROM chg"""


@register("one_step", _one_step_sql("return"))
def q_one_step(spark, sf):
    """P1 + P5: per-symbol ridge (fitted on the first 80 %, as the reference)
    predicts the next return from the newest bar; price, change and signal."""
    bars, ind, sup = _setup(spark, sf)
    _, _, model = M.backtest("ridge", sup)
    live = indicator_table(bars, drop_incomplete=False)
    return rounded(fc.one_step(live, sup, model))


@register("one_step_price", _one_step_sql("price"))
def q_one_step_price(spark, sf):
    """P1 + P5 with the price target: the ridge predicts the next close itself."""
    bars, ind, sup = _setup(spark, sf, "price")
    _, _, model = M.backtest("ridge", sup)
    live = indicator_table(bars, drop_incomplete=False)
    return rounded(fc.one_step(live, sup, model, "price"))


def _state_features() -> str:
    """The 22 features of the newest bar as SQL over a state row: c (50 closes),
    v (12 volumes), o, h, l."""
    def mean(x):
        return f"list_avg({x})"

    def delta(first, body):
        return f"list_transform(range({first}, 51), lambda i: {body})"

    gain, loss = (mean(delta(37, f"greatest({s}(c[i] - c[i - 1]), 0.0)")) for s in ("", "-"))
    logs = "ln(c[i]) - ln(c[i - 1])"
    found = {"open": "o", "high": "h", "low": "l", "volume": "v[12]", "ma_20": mean("c[31:50]"), "ma_50": mean("c"),
             "rsi": f"100.0 * {gain} / ({gain} + {loss})", "price_change": "c[50] / c[49] - 1.0", "log_return": "ln(c[50]) - ln(c[49])",
             "vol_5": f"list_stddev_samp({delta(46, logs)})", "vol_20": f"list_stddev_samp({delta(31, logs)})", "mom_5": "c[50] / c[45] - 1.0",
             "z_20": f"(c[50] - {mean('c[31:50]')}) / (list_stddev_samp(c[31:50]) + 1e-9)", "volume_ma": mean("v[3:12]")}
    for k in LAGS:
        found |= {f"close_lag_{k}": f"c[{50 - k}]", f"ret_lag_{k}": f"c[{50 - k}] / c[{49 - k}] - 1.0"}
    return "[" + ", ".join(found[f] for f in FEATURES) + "]"


def _iterative_sql(target):
    price = "y" if target == "price" else "c[50] * (1.0 + y / 100.0)"
    return f"""WITH RECURSIVE {base_ctes()}, {sup_cte(1, target)}, {ridge_ctes("sup")},
model AS MATERIALIZED (SELECT symbol, any_value(ybar) AS ybar, list(w ORDER BY idx) AS w, list(mu ORDER BY idx) AS mu, list(sd ORDER BY idx) AS sd FROM coef GROUP BY symbol),
tail AS (SELECT * FROM bars WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) <= 50),
st AS (
  SELECT 0 AS step, symbol, max(dt) AS dt, list(close ORDER BY dt) AS c, (list(CAST(volume AS DOUBLE) ORDER BY dt))[39:50] AS v,
    arg_max(open, dt) AS o, arg_max(high, dt) AS h, arg_max(low, dt) AS l, CAST(NULL AS DOUBLE) AS y FROM tail GROUP BY symbol HAVING count(*) = 50
  UNION ALL
  SELECT step + 1, symbol, CAST(dt + CASE dayofweek(dt) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE), c[2:50] || [p], v[2:12] || [v[12]], p, p * 1.01, p * 0.99, y
  FROM (SELECT *, {price} AS p FROM (
    SELECT step, symbol, dt, c, v, ybar + list_sum(list_transform(range(1, {len(FEATURES) + 1}), lambda i: w[i] * (x[i] - mu[i]) / sd[i])) AS y
    FROM (SELECT *, {_state_features()} AS x FROM st WHERE step < 30) a JOIN model USING (symbol)) b) d)
SELECT symbol, CAST(step AS INTEGER) AS step, dt, round(y, 4) AS y_hat, round(c[50], 4) AS price, 'ok' AS status FROM st WHERE step > 0"""


@register("iterative", _iterative_sql("return"))
def q_iterative(spark, sf):
    """P2 + P3: 30-day iterative forecast of per-symbol ridge from the raw bars."""
    bars, ind, sup = _setup(spark, sf)
    model = M.fit("ridge", sup)
    return rounded(fc.iterative_forecast(bars, model, 30), exact=())


@register("iterative_price", _iterative_sql("price"))
def q_iterative_price(spark, sf):
    """P2 + P3 with the price target: every predicted close is the next state's close."""
    bars, ind, sup = _setup(spark, sf, "price")
    model = M.fit("ridge", sup)
    return rounded(fc.iterative_forecast(bars, model, 30, "price"), exact=())


@register("forecast_status", f"""WITH {base_ctes(GAPPY_SQL)}, {sup_cte()},
held AS (SELECT symbol, count(*) AS bars, count(CASE WHEN open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL THEN 1 END) AS complete_bars
         FROM bars GROUP BY symbol)
SELECT symbol, bars, complete_bars, CASE WHEN complete_bars < 50 THEN 'insufficient history'
  WHEN symbol NOT IN (SELECT symbol FROM sup) THEN 'no model' ELSE 'ok' END AS status FROM held""")
def q_forecast_status(spark, sf):
    """P2 + D22: whether each of many symbols, some short or with gaps, can be forecast by its ridge."""
    bars = gappy_bars(spark, sf)
    model = M.fit("ridge", sv.supervised(indicator_table(bars)))
    return fc.forecast_status(bars, model)


@register("iterative_forest")
def q_iterative_forest(spark, sf):
    """P2 with one random forest per symbol, 30 days, all steps in one pass."""
    bars, ind, sup = _setup(spark, sf)
    model = M.fit("random_forest", sup, scope="symbol")
    return rounded(fc.iterative_forecast(bars, model, 30))


@register("iterative_gbt_large")
def q_iterative_gbt_large(spark, sf):
    """P2 with one regularised boosting model per symbol, 30 days."""
    bars, ind, sup = _setup(spark, sf)
    model = M.fit("gbt_large", sup, scope="symbol")
    return rounded(fc.iterative_forecast(bars, model, 30))


PRICE_PATH = f"""WITH {base_ctes()}, {sup_cte()},
t AS (SELECT * FROM (SELECT *, {HOLD} AS role FROM sup) h WHERE role = 'test'),
b AS (SELECT symbol, arg_min(close, dt) AS base_price FROM t GROUP BY symbol)
SELECT symbol, dt, round(CASE WHEN sum(CASE WHEN label > -100 THEN 0 ELSE 1 END) OVER w = 0
  THEN base_price * exp(CAST(sum(CAST(CASE WHEN label > -100 THEN ln(1.0 + label / 100.0) END AS DECIMAL(38, 12))) OVER w AS DOUBLE)) END, 4) AS path_price
FROM t JOIN b USING (symbol)
WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _holdout_path(spark, sf, **options):
    _, _, sup = _setup(spark, sf)
    t = sv.holdout(sup).where(F.col("role") == "test")
    base = t.groupBy("symbol").agg(F.min_by("close", "dt").alias("base_price"))
    p = fc.price_path(t.select("symbol", "dt", "label"), base, ret_col="label", order="dt", **options)
    return rounded(p.select("symbol", "dt", "path_price"))


@register("price_path", PRICE_PATH)
def q_price_path(spark, sf):
    """Compounding each hold-out row's next return onto the first hold-out close."""
    return _holdout_path(spark, sf)


@register("price_path_segmented", PRICE_PATH)
def q_price_path_segmented(spark, sf):
    """P4 as a prefix scan over segments of 64 rows."""
    return _holdout_path(spark, sf, segment_rows=64)
