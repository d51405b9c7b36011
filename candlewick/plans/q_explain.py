"""Explanation queries.

Importance, contributions and narrative of the per-symbol ridge, with one and
with all 22 features, are checked against SQL (``ridge_sql`` solves the normal
equations in DuckDB); the tree versions are row-checked here and tested
against additivity.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from candlewick.operators import explain as X
from candlewick.operators import models as M
from candlewick.operators import supervised as sv
from candlewick.operators.windows import indicator_table
from candlewick.plans.present import rounded
from candlewick.plans.q_supervised import sup_cte
from candlewick.plans.registry import register
from candlewick.plans.ridge_sql import predicted, ridge_ctes
from candlewick.plans.sqlkit import base_ctes
from candlewick.sources.trades import lineitem_bars


def _sup(spark, sf):
    return sv.supervised(indicator_table(lineitem_bars(spark, sf)))


ONE = f"""WITH {base_ctes()}, {sup_cte()},
co AS (SELECT symbol, mu, sd, ybar, sum((price_change - mu) / sd * (label - ybar)) / (cnt + 1.0) AS w
       FROM sup JOIN (SELECT symbol, count(*) AS cnt, avg(price_change) AS mu, stddev_pop(price_change) AS sd,
                             avg(label) AS ybar FROM sup GROUP BY symbol) s USING (symbol)
       GROUP BY symbol, cnt, mu, sd, ybar),
pred AS (SELECT symbol, dt, i, label, price_change AS v, ybar + w * (price_change - mu) / sd AS bp, w / sd AS c
         FROM sup JOIN co USING (symbol))"""


def _r2(src: str, keys: str, pred: str) -> str:
    return f"""SELECT {keys}, CASE WHEN count(*) < 2 THEN NULL
  WHEN var_pop(label) * count(*) = 0 THEN CASE WHEN sum((label - {pred}) ^ 2) = 0 THEN 1.0 ELSE 0.0 END
  ELSE 1.0 - sum((label - {pred}) ^ 2) / (var_pop(label) * count(*)) END AS r2 FROM {src} GROUP BY {keys}"""


@register("importance_linear", ONE + f""",
reps AS (SELECT *, CAST(r AS INTEGER) AS rep FROM pred, range(0, 10) t(r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, rep ORDER BY
  md5(concat_ws('|', '42', CAST(rep AS VARCHAR), symbol, CAST(dt AS VARCHAR))), dt) - 1 AS pr FROM reps),
perm AS (SELECT a.symbol, a.rep, a.label, a.bp + a.c * (d.v - a.v) AS pp
         FROM ranked a JOIN ranked d ON a.symbol = d.symbol AND a.rep = d.rep AND a.i = d.pr),
pr2 AS ({_r2("perm", "symbol, rep", "pp")}),
br2 AS ({_r2("pred", "symbol", "bp")})
SELECT symbol, 'price_change' AS feature, round(max(br2.r2) - avg(pr2.r2), 4) AS importance,
  round(stddev_pop(pr2.r2), 4) AS importance_std, CAST(1 AS INTEGER) AS rank
FROM pr2 JOIN br2 USING (symbol) GROUP BY symbol""")
def q_importance_linear(spark, sf):
    """X1 + L3: permutation importance (10 repeats, seed 42) of the one-feature ridge."""
    sup = _sup(spark, sf)
    m = M.fit("ridge", sup, features=["price_change"])
    return rounded(X.rank_importance(X.permutation_importance(m, sup)))


RIDGE = f"""WITH RECURSIVE {base_ctes()}, {sup_cte()}, {ridge_ctes("sup")}, {predicted("sup", "symbol, dt, i, label")}"""
PHI = RIDGE + """,
bgr AS (SELECT rid FROM (SELECT rid, row_number() OVER (PARTITION BY symbol ORDER BY md5(concat_ws('|', '42', symbol, CAST(dt AS VARCHAR))), dt) AS rn FROM te_n) a WHERE rn <= 200),
bg AS (SELECT symbol, f, avg(v) AS bgv FROM te JOIN bgr USING (rid) GROUP BY symbol, f),
lastr AS (SELECT symbol, arg_max(rid, dt) AS rid FROM te_n GROUP BY symbol),
phis AS (SELECT te.symbol, te.dt, te.f AS feature, w / sd * (v - bgv) AS phi FROM te JOIN lastr USING (rid) JOIN bg ON bg.symbol = te.symbol AND bg.f = te.f
         JOIN coef ON coef.symbol = te.symbol AND coef.idx = te.idx),
ct AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank FROM phis)"""


@register("importance_ridge", RIDGE + f""",
base AS (SELECT te.rid, te.symbol, te.dt, te.i, te.label, te.f, te.v, p.pred AS bp, w / sd AS c FROM te JOIN pred p USING (rid)
         JOIN coef ON coef.symbol = te.symbol AND coef.idx = te.idx),
reps AS (SELECT *, CAST(r AS INTEGER) AS rep FROM base, range(0, 10) t(r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, f, rep ORDER BY
  md5(concat_ws('|', '42', CAST(rep AS VARCHAR), symbol, CAST(dt AS VARCHAR))), dt) - 1 AS pr FROM reps),
perm AS (SELECT a.symbol, a.f, a.rep, a.label, a.bp + a.c * (d.v - a.v) AS pp
         FROM ranked a JOIN ranked d ON a.symbol = d.symbol AND a.f = d.f AND a.rep = d.rep AND a.i = d.pr),
pr2 AS ({_r2("perm", "symbol, f, rep", "pp")}),
br2 AS ({_r2("pred", "symbol", "pred")}),
imp AS (SELECT symbol, f AS feature, max(br2.r2) - avg(pr2.r2) AS importance, stddev_pop(pr2.r2) AS importance_std FROM pr2 JOIN br2 USING (symbol) GROUP BY symbol, f)
SELECT symbol, feature, round(importance, 4) AS importance, round(importance_std, 4) AS importance_std,
  CAST(row_number() OVER (PARTITION BY symbol ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM imp""")
def q_importance_ridge(spark, sf):
    """X1 + L3: permutation importance of the 22-feature per-symbol ridge, ranked."""
    sup = _sup(spark, sf)
    return rounded(X.rank_importance(X.permutation_importance(M.fit("ridge", sup), sup)))


@register("importance_forest")
def q_importance_forest(spark, sf):
    """X1 + L3: permutation importance of the pooled random forest (all rows, as the reference)."""
    sup = _sup(spark, sf)
    return rounded(X.rank_importance(X.permutation_importance(M.fit("random_forest", sup), sup)))


@register("contributions_linear", ONE + """,
bg AS (SELECT symbol, avg(v) AS bgv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY
         md5(concat_ws('|', '42', symbol, CAST(dt AS VARCHAR))), dt) AS rn FROM pred) a WHERE rn <= 200 GROUP BY symbol),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM pred) a WHERE rn = 1)
SELECT symbol, dt, 'price_change' AS feature, round(c * (v - bgv), 4) AS phi, CAST(1 AS INTEGER) AS rank
FROM last JOIN bg USING (symbol)""")
def q_contributions_linear(spark, sf):
    """X2 + W13: linear contribution of the one-feature ridge for the latest row (background: 200-row sample)."""
    sup = _sup(spark, sf)
    m = M.fit("ridge", sup, features=["price_change"])
    return rounded(X.linear_contributions(m, sup))


@register("contributions_ridge", PHI + " SELECT symbol, dt, feature, round(phi, 4) AS phi, rank FROM ct")
def q_contributions_ridge(spark, sf):
    """X2 + W13: linear contributions of the 22-feature ridge, ranked by |phi|."""
    sup = _sup(spark, sf)
    return rounded(X.linear_contributions(M.fit("ridge", sup), sup))


@register("shapley_forest")
def q_shapley_forest(spark, sf):
    """Sampled Shapley values of the pooled forest for the latest row per symbol."""
    sup = _sup(spark, sf)
    return rounded(X.sampled_shapley(M.fit("random_forest", sup), sup, orders=8))


@register("contributions_forest")
def q_contributions_forest(spark, sf):
    """X3 + W13: exact contributions of one forest per symbol for its latest row, ranked by |phi|."""
    sup = _sup(spark, sf)
    return rounded(X.exact_tree_contributions(M.fit("random_forest", sup, scope="symbol"), sup))


@register("contributions_forest_facts", f"""WITH {base_ctes()}, {sup_cte()}
SELECT symbol, CAST(22 AS BIGINT) AS features, true AS adds_up, true AS ranks_agree FROM sup GROUP BY symbol""")
def q_contributions_forest_facts(spark, sf):
    """Per symbol, every feature has a contribution, and base value plus
    contributions give the prediction to 1e-9."""
    sup = _sup(spark, sf)
    c = X.exact_tree_contributions(M.fit("gbt_large", sup, scope="symbol"), sup)
    return c.groupBy("symbol").agg(F.count("feature").alias("features"), (F.abs(F.max("base_value") + F.sum("phi") - F.max("prediction")) < 1e-9).alias("adds_up"),
                                   (F.max_by(F.abs("phi"), -F.col("rank")) == F.max(F.abs("phi"))).alias("ranks_agree"))


NARR = ONE + """,
bg AS (SELECT symbol, avg(v) AS bgv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY
         md5(concat_ws('|', '42', symbol, CAST(dt AS VARCHAR))), dt) AS rn FROM pred) a WHERE rn <= 200 GROUP BY symbol),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM pred) a WHERE rn = 1),
ct AS (SELECT symbol, 'price_change' AS feature, c * (v - bgv) AS phi FROM last JOIN bg USING (symbol))"""


@register("top5_narrative", NARR + """
SELECT symbol, '- **' || feature || '** ' || CASE WHEN phi > 0 THEN 'increased' ELSE 'decreased' END
  || ' the forecast by ~' || printf('%.2f', round(abs(phi), 2)) || '%' AS narrative FROM ct""")
def q_top5_narrative(spark, sf):
    """Narrative of the top contributions (one-feature ridge, return target)."""
    sup = _sup(spark, sf)
    m = M.fit("ridge", sup, features=["price_change"])
    return X.narrative(X.linear_contributions(m, sup))


@register("net_effect", NARR + """
SELECT symbol, round(sum(phi), 4) AS net_effect, CASE WHEN sum(phi) > 0 THEN 'bullish' ELSE 'bearish' END AS bias
FROM ct GROUP BY symbol""")
def q_net_effect(spark, sf):
    """Net effect and bias (one-feature ridge)."""
    sup = _sup(spark, sf)
    m = M.fit("ridge", sup, features=["price_change"])
    return rounded(X.net_effect(X.linear_contributions(m, sup)))


@register("narrative_ridge", PHI + """
SELECT symbol, string_agg('- **' || feature || '** ' || CASE WHEN phi > 0 THEN 'increased' ELSE 'decreased' END
  || ' the forecast by ~' || printf('%.2f', round(abs(phi), 2)) || '%', chr(10) ORDER BY rank) FILTER (WHERE rank <= 5) AS narrative,
  round(sum(phi), 4) AS net_effect, CASE WHEN sum(phi) > 0 THEN 'bullish' ELSE 'bearish' END AS bias
FROM ct GROUP BY symbol""")
def q_narrative_ridge(spark, sf):
    """X4 + X5: top-5 narrative and net effect of the 22-feature ridge."""
    sup = _sup(spark, sf)
    c = X.linear_contributions(M.fit("ridge", sup), sup)
    return rounded(X.narrative(c).join(X.net_effect(c), "symbol"))
