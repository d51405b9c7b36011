"""Model queries (M1-M7, V4-V7): walk-forward CV, back-tests, training, search.

Models are fitted with the reference's presets.  The ridge queries are checked
against normal equations solved in DuckDB (``ridge_sql``), the lasso queries
against coordinate descent there; trees by row count and stated facts here and
against plain numpy trees in tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.operators import linear
from candlewick.operators import models as M
from candlewick.operators import supervised as sv
from candlewick.operators import trees as tr
from candlewick.operators.windows import indicator_columns, indicator_table
from candlewick.plans.present import rounded
from candlewick.plans.q_supervised import HOLD, folds_cte, sup_cte
from candlewick.plans.registry import register
from candlewick.plans.ridge_sql import lasso_ctes, predicted, ridge_ctes, scores
from candlewick.plans.sqlkit import BARS, COMPLETE, base_ctes
from candlewick.schema import FEATURES
from candlewick.sources.trades import lineitem_bars


def _sup(spark, sf, target="return"):
    return sv.supervised(indicator_table(lineitem_bars(spark, sf)), 1, target)


def _cv(name, target="return"):
    def q(spark, sf):
        fm, _ = M.cv_score(name, _sup(spark, sf, target), 5)
        return rounded(fm)

    q.__doc__ = f"V4: 5-fold walk-forward metrics of {name} per (symbol, fold), {target} target."
    return q


def _fold_sets(target="return"):
    return f"""WITH RECURSIVE {base_ctes()}, {sup_cte(1, target)}, {folds_cte()},
trn AS (SELECT * FROM folds WHERE role = 'train'), tst AS (SELECT * FROM folds WHERE role = 'test')"""


def _fold_scores(target="return"):
    return f"""{_fold_sets(target)}, {ridge_ctes("trn", "symbol, fold")}, {predicted("tst", "symbol, fold, label", "symbol, fold")},
fm AS ({scores("pred", "symbol, fold")})"""


def _hold_sets(target="return"):
    return f"""WITH RECURSIVE {base_ctes()}, {sup_cte(1, target)}, hold AS (SELECT *, {HOLD} AS role FROM sup),
trn AS (SELECT * FROM hold WHERE role = 'train'), tst AS (SELECT * FROM hold WHERE role = 'test')"""


FOLD_SETS, FOLD_SCORES, HOLD_SETS = _fold_sets(), _fold_scores(), _hold_sets()

register("cv_ridge", f"{FOLD_SCORES} SELECT symbol, fold, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2 FROM fm")(_cv("ridge"))
register("cv_lasso", f"""{FOLD_SETS}, {lasso_ctes("trn", "symbol, fold")}, {predicted("tst", "symbol, fold, label", "symbol, fold")},
fm AS ({scores("pred", "symbol, fold")}) SELECT symbol, fold, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2 FROM fm""")(_cv("lasso"))
register("cv_ridge_price", f"{_fold_scores('price')} SELECT symbol, fold, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2 FROM fm")(_cv("ridge", "price"))
register("cv_forest")(_cv("random_forest"))
register("cv_gbt")(_cv("gbt"))


def _bt(name, scope=None, target="return"):
    def q(spark, sf):
        bt, _, _ = M.backtest(name, _sup(spark, sf, target), scope=scope)
        return rounded(bt, exact=("actual",) if target == "price" else ())

    q.__doc__ = f"V5: hold-out back-test of {name}: actual and predicted for the last 20 % per symbol."
    return q


register("backtest", f"""{HOLD_SETS}, {ridge_ctes("trn")}, {predicted("tst", "symbol, dt, label")}
SELECT symbol, dt, round(label, 4) AS actual, round(pred, 4) AS predicted FROM pred""")(_bt("ridge"))
register("backtest_price", f"""{_hold_sets("price")}, {ridge_ctes("trn")}, {predicted("tst", "symbol, dt, label")}
SELECT symbol, dt, round(label, 8) AS actual, round(pred, 4) AS predicted FROM pred""")(_bt("ridge", target="price"))
register("backtest_forest")(_bt("random_forest"))
register("backtest_gbt")(_bt("gbt"))
register("gbt_large")(_bt("gbt_large"))


@register("backtest_metrics_lasso", f"""{HOLD_SETS}, {lasso_ctes("trn")}, {predicted("tst", "symbol, dt, label")},
fm AS ({scores("pred", "symbol")})
SELECT symbol, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2,
  CASE WHEN r2 > 0.8 THEN 'excellent' WHEN r2 > 0.6 THEN 'good' WHEN r2 > 0.4 THEN 'moderate' ELSE 'poor' END AS grade FROM fm""")
def q_backtest_metrics_lasso(spark, sf):
    """V5: hold-out metrics of per-symbol lasso with the R^2 grade."""
    from candlewick.functions.grades import r2_grade

    _, m, _ = M.backtest("lasso", _sup(spark, sf))
    return rounded(m.withColumn("grade", r2_grade(F.col("r2"))))


@register("train_model", f"""{FOLD_SCORES},
fin AS (SELECT symbol, count(*) AS final_rows FROM sup GROUP BY symbol)
SELECT symbol, fold, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2, final_rows, CAST(22 AS INTEGER) AS features
FROM fm JOIN fin USING (symbol)""")
def q_train_model(spark, sf):
    """V6: ridge trained with its CV table, then fitted on all rows; returns
    the fold table joined with the final per-symbol coefficients' size."""
    fitted, fm, means = M.train_model("ridge", _sup(spark, sf))
    final = fitted.coefs.select("symbol", F.col("n").alias("final_rows"), F.size("w").alias("features"))
    return rounded(fm.join(final, "symbol"))


@register("random_search", f"""{FOLD_SETS}, {ridge_ctes("trn", "symbol, fold", "(VALUES (0.1), (1.0), (10.0))")},
{predicted("tst", "symbol, fold, label", "symbol, fold")},
fm AS ({scores("pred", "symbol, alpha, fold")}),
sm AS (SELECT symbol, alpha, count(*) AS folds, avg(rmse) AS cv_rmse, avg(mae) AS cv_mae, avg(r2) AS cv_r2 FROM fm GROUP BY symbol, alpha)
SELECT symbol, round(alpha, 4) AS alpha, folds, round(cv_rmse, 4) AS cv_rmse, round(cv_mae, 4) AS cv_mae, round(cv_r2, 4) AS cv_r2,
  row_number() OVER (PARTITION BY symbol ORDER BY cv_rmse, alpha) = 1 AS best FROM sm""")
def q_random_search(spark, sf):
    """V7: every alpha of the ridge grid scored by walk-forward RMSE per symbol; best flagged."""
    _, table = M.random_search("ridge", _sup(spark, sf), 5, 20)
    return rounded(table)


@register("train_model_tuned", f"""{FOLD_SETS}, {ridge_ctes("trn", "symbol, fold", "(VALUES (0.1), (1.0), (10.0))")},
{predicted("tst", "symbol, fold, label", "symbol, fold")},
fm AS ({scores("pred", "symbol, alpha, fold")}),
best AS (SELECT symbol, arg_min(alpha, (cv_rmse, alpha)) AS alpha FROM (SELECT symbol, alpha, avg(rmse) AS cv_rmse FROM fm GROUP BY symbol, alpha) s GROUP BY symbol),
fin AS (SELECT symbol, count(*) AS final_rows FROM sup GROUP BY symbol)
SELECT symbol, fold, alpha, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2, final_rows
FROM fm JOIN best USING (symbol, alpha) JOIN fin USING (symbol)""")
def q_train_model_tuned(spark, sf):
    """V6 + V7: per-symbol best alpha by walk-forward search, its fold table, and the refit on all rows."""
    fitted, fm, _ = M.train_model("ridge", _sup(spark, sf), tune=True)
    final = fitted.coefs.select("symbol", "alpha", F.col("n").alias("final_rows"))
    return rounded(fm.join(final, "symbol"))


# bars with holes: opens of every seventh day and volumes of every 13th are missing
HOLEY = f"""SELECT symbol, dt, CASE WHEN day(dt) % 7 <> 0 THEN open END AS open, high, low, close, CASE WHEN day(dt) <> 13 THEN volume END AS volume, source FROM ({BARS}) b"""


def _holey_sup(spark, sf):
    """V1 over all rows that have a close of their own and of the next row; other columns may be missing."""
    bars = lineitem_bars(spark, sf)
    bars = bars.withColumn("open", F.when(F.dayofmonth("dt") % 7 != 0, F.col("open"))).withColumn("volume", F.when(F.dayofmonth("dt") != 13, F.col("volume")))
    return sv.supervised(indicator_columns(bars).where(F.col("ma_50").isNotNull()))


HOLEY_FOLDS = f"""WITH RECURSIVE {base_ctes(HOLEY).replace(f"WHERE {COMPLETE})", "WHERE ma_50 IS NOT NULL)", 1)}, {sup_cte()}, {folds_cte()},
med AS (SELECT symbol, fold, {", ".join(f"median({f}) AS m_{f}" for f in FEATURES)} FROM folds WHERE role = 'train' GROUP BY symbol, fold),
filled AS (SELECT symbol, fold, role, label, {", ".join(f"coalesce({f}, m_{f}) AS {f}" for f in FEATURES)} FROM folds JOIN med USING (symbol, fold)),
trn AS (SELECT * FROM filled WHERE role = 'train'), tst AS (SELECT * FROM filled WHERE role = 'test')"""


@register("cv_ridge_imputed", f"""{HOLEY_FOLDS}, {ridge_ctes("trn", "symbol, fold")}, {predicted("tst", "symbol, fold, label", "symbol, fold")},
fm AS ({scores("pred", "symbol, fold")})
SELECT symbol, fold, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2 FROM fm""")
def q_cv_ridge_imputed(spark, sf):
    """M1 + V4: ridge over bars with holes; missing features take the median of the fold's training rows."""
    fm, _ = M.cv_score("ridge", _holey_sup(spark, sf), 5, impute="median")
    return rounded(fm)


@register("search_lasso", f"""{FOLD_SETS}, {lasso_ctes("trn", "symbol, fold", "(VALUES (0.0001), (0.001), (0.01))")},
{predicted("tst", "symbol, fold, label", "symbol, fold")},
fm AS ({scores("pred", "symbol, alpha, fold")}),
sm AS (SELECT symbol, alpha, count(*) AS folds, avg(rmse) AS cv_rmse, avg(mae) AS cv_mae, avg(r2) AS cv_r2 FROM fm GROUP BY symbol, alpha)
SELECT symbol, round(alpha, 4) AS alpha, folds, round(cv_rmse, 4) AS cv_rmse, round(cv_mae, 4) AS cv_mae, round(cv_r2, 4) AS cv_r2,
  row_number() OVER (PARTITION BY symbol ORDER BY cv_rmse, alpha) = 1 AS best FROM sm""")
def q_search_lasso(spark, sf):
    """V7: every alpha of the lasso grid scored by walk-forward RMSE per symbol; best flagged."""
    _, table = M.random_search("lasso", _sup(spark, sf), 5, 20)
    return rounded(table)


PATH_ALPHAS = [0.0001, 0.001, 0.01, 0.1, 1.0]
_PENALTIES = "(VALUES " + ", ".join(f"({a})" for a in PATH_ALPHAS) + ")"


@register("lasso_path", f"""WITH RECURSIVE {base_ctes()}, {sup_cte()}, {lasso_ctes("sup", "symbol", _PENALTIES)},
top AS (SELECT symbol, max(abs(v) / cnt) AS alpha_max FROM gram JOIN cnt USING (symbol) WHERE j = {len(FEATURES)} GROUP BY symbol),
quad AS (SELECT a.symbol, a.alpha, sum(0.5 * a.w * b.w * v / cnt) AS s FROM coef a JOIN coef b ON a.symbol = b.symbol AND a.alpha = b.alpha
         JOIN gram ON gram.symbol = a.symbol AND gram.i = a.idx AND gram.j = b.idx JOIN cnt ON cnt.symbol = a.symbol GROUP BY a.symbol, a.alpha),
lin AS (SELECT coef.symbol, coef.alpha, sum(alpha * abs(w) - w * v / cnt) AS s FROM coef JOIN gram ON gram.symbol = coef.symbol AND gram.i = coef.idx AND gram.j = {len(FEATURES)}
        JOIN cnt ON cnt.symbol = coef.symbol GROUP BY coef.symbol, coef.alpha)
SELECT symbol, alpha, round(alpha_max, 4) AS alpha_max, round(quad.s + lin.s, 4) AS objective, true AS optimal
FROM quad JOIN lin USING (symbol, alpha) JOIN top USING (symbol)""")
def q_lasso_path(spark, sf):
    """M5: the lasso's homotopy path of every symbol at five penalties: the
    penalty from which on all coefficients are zero, the objective (up to the
    label's variance) and the optimality conditions.  The oracle minimises the
    same objective by coordinate descent."""
    path = linear.lasso_path(_sup(spark, sf), ["symbol"], FEATURES, PATH_ALPHAS)
    fine = (F.col("gap") <= 1e-8 * (1 + F.abs("objective"))) & (F.col("excess") <= 1e-8 * (1 + F.col("alpha_max")))
    return rounded(path.select("symbol", "alpha", "alpha_max", "objective", fine.alias("optimal")))


@register("ridge_one_feature", f"""WITH {base_ctes()}, {sup_cte()},
st AS (SELECT symbol, count(*) AS cnt, avg(price_change) AS mu, stddev_pop(price_change) AS sd, avg(label) AS ybar
       FROM sup GROUP BY symbol)
SELECT symbol, cnt AS n, round(ybar, 4) AS ybar,
  round(sum((price_change - mu) / sd * (label - ybar)) / (cnt + 1.0), 4) AS w
FROM sup JOIN st USING (symbol) GROUP BY symbol, cnt, ybar""")
def q_ridge_one_feature(spark, sf):
    """M4 on one standardised feature (price_change): w = Sxy / (n + alpha)."""
    m = M.fit("ridge", _sup(spark, sf), features=["price_change"])
    return rounded(m.coefs.select("symbol", "n", "ybar", F.element_at("w", 1).alias("w")))


# --- tree models per symbol -----------------------------------------------------

def _cv_symbol(name):
    def q(spark, sf):
        fm, _ = M.cv_score(name, _sup(spark, sf), 5, scope="symbol")
        return rounded(fm)

    q.__doc__ = f"V4: 5-fold walk-forward metrics of one {name} per symbol, all folds over one binned table."
    return q


for _name, _model in (("forest", "random_forest"), ("gbt", "gbt"), ("gbt_large", "gbt_large")):
    register(f"cv_{_name}_symbol")(_cv_symbol(_model))
    register(f"backtest_{_name}_symbol")(_bt(_model, "symbol"))


def _search_trees(name):
    def q(spark, sf):
        _, table = M.random_search(name, _sup(spark, sf), 5, 20, scope="symbol")
        return rounded(table)

    q.__doc__ = f"V7: 20 draws of the reference's full {name} grid, scored by walk-forward RMSE per symbol; best flagged."
    return q


register("search_forest")(_search_trees("random_forest"))
register("search_gbt")(_search_trees("gbt"))
register("search_gbt_large")(_search_trees("gbt_large"))


@register("tree_fold_facts", f"""{FOLD_SETS},
r AS (SELECT symbol, fold, count(*) AS train_rows, min(label) AS lo, max(label) AS hi FROM trn GROUP BY symbol, fold)
SELECT symbol, fold, train_rows, count(*) AS test_rows, round(avg(label), 4) AS mean_label, true AS in_range, true AS tells_apart
FROM tst JOIN r USING (symbol, fold) GROUP BY symbol, fold, train_rows""")
def q_tree_fold_facts(spark, sf):
    """M2 + V4: what must hold of the forests of every (symbol, fold): rows of
    both parts, predictions inside the training labels' range, not constant."""
    sup = _sup(spark, sf)
    data = tr.packed(sv.blocks(sup, 5), ["symbol"], FEATURES, block="fold").checkpoint(eager=True)
    models = tr.fit_trees(data, ["symbol"], [tr.Job(0, f, M.tree_params("random_forest")) for f in range(1, 6)])
    pred = tr.score_blocks(data, models, ["symbol"])
    b = sv.blocks(sup, 5).select("symbol", F.col("fold").alias("block"), "label")
    ranges = b.join(b.select("symbol", F.col("block").alias("fold")).where("fold > 0").distinct(), "symbol").where("block < fold").groupBy("symbol", "fold").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"))
    facts = pred.groupBy("symbol", "fold").agg(F.count("*").alias("test_rows"), F.avg("label").alias("mean_label"), F.min("prediction").alias("least"),
                                               F.max("prediction").alias("most"))
    return rounded(facts.join(ranges, ["symbol", "fold"]).join(models.select("symbol", "fold", "train_rows"), ["symbol", "fold"]).select(
        "symbol", "fold", "train_rows", "test_rows", "mean_label", ((F.col("least") >= F.col("lo")) & (F.col("most") <= F.col("hi"))).alias("in_range"),
        (F.col("most") > F.col("least")).alias("tells_apart")))


@register("tree_leaf_sums", f"""WITH {base_ctes()}, {sup_cte()}
SELECT symbol, count(*) AS rows, round(avg(label), 4) AS mean_label, round(avg(label), 4) AS root_value FROM sup GROUP BY symbol""")
def q_tree_leaf_sums(spark, sf):
    """M2: the leaves of one unsampled tree per symbol hold all its rows, and
    their values average to the label's mean, as the root's does."""
    data = tr.packed(_sup(spark, sf), ["symbol"], FEATURES)
    models = tr.fit_trees(data, ["symbol"], [tr.Job(0, 0, tr.TreeParams(boost=False, trees=1, depth=6, min_weight=5))])
    nodes = models.select("symbol", F.explode(F.arrays_zip("feature", "value", "weight")).alias("n"), F.element_at("value", 1).alias("root_value")).where("n.feature < 0")
    return rounded(nodes.groupBy("symbol", "root_value").agg(F.sum("n.weight").cast("long").alias("rows"),
                                                             (F.sum(F.col("n.weight") * F.col("n.value")) / F.sum("n.weight")).alias("mean_label")))
