"""Queries for the supervised set, folds, hold-out and metrics.

Metrics here use a column as the predictor (today's percent return as the
forecast of the next one), so every number is checkable in SQL before any
model is fitted.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.grades import r2_grade
from candlewick.operators import metrics as met
from candlewick.operators import supervised as sv
from candlewick.operators.projections import seeded_sample
from candlewick.operators.windows import indicator_table
from candlewick.plans.present import rounded, sql_round
from candlewick.plans.registry import register
from candlewick.plans.sqlkit import base_ctes, pct
from candlewick.schema import FEATURES
from candlewick.sources.trades import lineitem_bars

W = "(PARTITION BY symbol ORDER BY dt)"


def sup_cte(h: int = 1, target: str = "return") -> str:
    label = f"lead(_r, {h}) OVER {W} * 100.0" if target == "return" else f"lead(close, {h}) OVER {W}"
    return f"""sup AS (
  SELECT symbol, dt, CAST(i AS INTEGER) AS i, CAST(n_all - {h} AS INTEGER) AS n, close, {", ".join(FEATURES)}, label
  FROM (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n_all, {label} AS label
        FROM (SELECT *, {pct('close', f'lag(close) OVER {W}')} AS _r FROM ind) a) b
  WHERE i < n_all - {h})"""


def _sup(spark, sf, h=1, target="return"):
    return sv.supervised(indicator_table(lineitem_bars(spark, sf)), h, target)


SUP_COLS = ["symbol", "dt", "i", "n", "close", *FEATURES, "label"]
SUP_DOUBLES = ["close", *FEATURES, "label"]


@register("supervised_return", f"WITH {base_ctes()}, {sup_cte()} SELECT {sql_round(SUP_COLS, doubles=SUP_DOUBLES)} FROM sup")
def q_supervised_return(spark, sf):
    """V1: 22 features and the next-row percent return as label."""
    return rounded(_sup(spark, sf))


@register("supervised_price", f"""WITH {base_ctes()}, {sup_cte(3, 'price')}
SELECT {sql_round(SUP_COLS, doubles=SUP_DOUBLES, exact=['close', 'label', 'open', 'high', 'low', 'volume',
        'close_lag_1', 'close_lag_2', 'close_lag_3', 'close_lag_5'])} FROM sup""")
def q_supervised_price(spark, sf):
    """V1: price target three rows ahead (the last three rows have no label)."""
    return rounded(_sup(spark, sf, 3, "price"), exact=["close", "label", "open", "high", "low", "volume",
                                                       "close_lag_1", "close_lag_2", "close_lag_3", "close_lag_5"])


def folds_cte(k: int = 5) -> str:
    return f"""fl AS (
  SELECT *, CASE WHEN i < n - ({k + 1} - fold) * t THEN 'train' WHEN i < n - ({k + 1} - fold) * t + t THEN 'test' END AS role
  FROM (SELECT *, CAST(floor(n / {k + 1}) AS INTEGER) AS t FROM sup WHERE n >= {k + 1}) s, range(1, {k + 1}) f(fold_)
  , LATERAL (SELECT CAST(fold_ AS INTEGER) AS fold) x),
folds AS (SELECT * FROM fl WHERE role IS NOT NULL)"""


@register("folds", f"""WITH {base_ctes()}, {sup_cte()}, {folds_cte()}
SELECT symbol, fold, role, count(*) AS rows, min(i) AS first_i, max(i) AS last_i FROM folds GROUP BY symbol, fold, role""")
def q_folds(spark, sf):
    """V2: walk-forward fold bounds per symbol (5 folds)."""
    f = sv.folds(_sup(spark, sf), 5)
    return f.groupBy("symbol", "fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


HOLD = "CASE WHEN i < CAST(floor(n * 0.8) AS INTEGER) THEN 'train' ELSE 'test' END"


@register("holdout", f"""WITH {base_ctes()}, {sup_cte()}
SELECT symbol, role, count(*) AS rows, min(dt) AS first_dt, max(dt) AS last_dt
FROM (SELECT *, {HOLD} AS role FROM sup) a GROUP BY symbol, role""")
def q_holdout(spark, sf):
    """V3: 80/20 time-ordered hold-out split per symbol."""
    h = sv.holdout(_sup(spark, sf))
    return h.groupBy("symbol", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("dt").alias("first_dt"),
                                           F.max("dt").alias("last_dt"))


def metrics_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, sqrt(sum((label - prediction) ^ 2) / count(*)) AS rmse,
  avg(abs(label - prediction)) AS mae,
  CASE WHEN count(*) < 2 THEN NULL
       WHEN var_pop(label) * count(*) = 0 THEN CASE WHEN sum((label - prediction) ^ 2) = 0 THEN 1.0 ELSE 0.0 END
       ELSE 1.0 - sum((label - prediction) ^ 2) / (var_pop(label) * count(*)) END AS r2
FROM {src} WHERE label IS NOT NULL AND prediction IS NOT NULL GROUP BY {keys}"""


def _naive(df):
    return df.withColumn("prediction", F.col("price_change") * F.lit(100.0))


FOLD_METRICS = f"""fm AS ({metrics_sql("(SELECT *, price_change * 100.0 AS prediction FROM folds WHERE role = 'test')", "symbol, fold")})"""
TEST_METRICS = f"""tm AS ({metrics_sql(f"(SELECT *, price_change * 100.0 AS prediction FROM (SELECT *, {HOLD} AS role FROM sup) h WHERE role = 'test')", "symbol")})"""


def _fold_metrics(spark, sf):
    f = _naive(sv.folds(_sup(spark, sf), 5)).where(F.col("role") == "test")
    return met.regression_metrics(f, ["symbol", "fold"])


@register("regression_metrics", f"""WITH {base_ctes()}, {sup_cte()}, {folds_cte()}, {FOLD_METRICS}
SELECT symbol, fold, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2 FROM fm""")
def q_regression_metrics(spark, sf):
    """A10: RMSE/MAE/R^2 per (symbol, fold) of the persistence predictor."""
    return rounded(_fold_metrics(spark, sf))


@register("fold_means", f"""WITH {base_ctes()}, {sup_cte()}, {folds_cte()}, {FOLD_METRICS}
SELECT symbol, count(*) AS folds, round(avg(rmse), 4) AS cv_rmse, round(avg(mae), 4) AS cv_mae, round(avg(r2), 4) AS cv_r2
FROM fm GROUP BY symbol""")
def q_fold_means(spark, sf):
    """Mean fold metrics per symbol."""
    return rounded(met.fold_means(_fold_metrics(spark, sf)))


@register("metric_record", f"""WITH {base_ctes()}, {sup_cte()}, {folds_cte()}, {FOLD_METRICS}, {TEST_METRICS},
cv AS (SELECT symbol, avg(rmse) AS cv_rmse, avg(mae) AS cv_mae, avg(r2) AS cv_r2 FROM fm GROUP BY symbol),
ts AS (SELECT symbol, count(*) AS train_size FROM (SELECT *, {HOLD} AS role FROM sup) h WHERE role = 'train' GROUP BY symbol)
SELECT tm.symbol, ts.train_size, '{", ".join(FEATURES)}' AS features, round(rmse, 4) AS test_rmse, round(mae, 4) AS test_mae, round(r2, 4) AS test_r2, n AS test_size,
  round(cv_rmse, 4) AS cv_rmse, round(cv_mae, 4) AS cv_mae, round(cv_r2, 4) AS cv_r2,
  CASE WHEN r2 > 0.8 THEN 'excellent' WHEN r2 > 0.6 THEN 'good' WHEN r2 > 0.4 THEN 'moderate' ELSE 'poor' END AS grade
FROM tm LEFT JOIN cv USING (symbol) LEFT JOIN ts USING (symbol)""")
def q_metric_record(spark, sf):
    """A12 + F11: CV means beside hold-out metrics, with the R^2 grade."""
    sup = _sup(spark, sf)
    parts = sv.holdout(sup)
    sizes = parts.where(F.col("role") == "train").groupBy("symbol").agg(F.count(F.lit(1)).alias("train_size"))
    test = _naive(parts).where(F.col("role") == "test")
    tm = met.regression_metrics(test, ["symbol"])
    cv = met.fold_means(_fold_metrics(spark, sf))
    rec = met.metric_record(cv, tm, train_sizes=sizes, features=FEATURES)
    return rounded(rec.withColumn("grade", r2_grade(F.col("test_r2"))))


@register("sample200", f"""WITH {base_ctes()}, {sup_cte()}
SELECT symbol, dt, i FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY md5(concat_ws('|', '42', symbol, CAST(dt AS VARCHAR))), dt) AS rn FROM sup) a
WHERE rn <= 200""")
def q_sample200(spark, sf):
    """L4: seeded sample of up to 200 supervised rows per symbol."""
    return seeded_sample(_sup(spark, sf), 200, 42).select("symbol", "dt", "i")


@register("supervised_segmented", f"WITH {base_ctes()}, {sup_cte()} SELECT {sql_round(SUP_COLS, doubles=SUP_DOUBLES)} FROM sup")
def q_supervised_segmented(spark, sf):
    """V1 over 1,000-row segments: positions from bucket counts, no whole-symbol window."""
    ind = indicator_table(lineitem_bars(spark, sf), segment_rows=1000)
    return rounded(sv.supervised(ind, segment_rows=1000))
