import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.operators import explain as X
from candlewick.operators import forecast as fc
from candlewick.operators import linear
from candlewick.operators import models as M
from candlewick.operators import supervised as sv
from candlewick.operators.windows import indicator_columns, indicator_table
from candlewick.schema import FEATURES, OHLCV
from candlewick.sources.trades import lineitem_bars

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sup(spark):
    s = sv.supervised(indicator_table(lineitem_bars(spark, SF))).persist()
    yield s
    s.unpersist()


def _sup_n(spark, n):
    rows = [("S", i, n) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, i int, n int")


@pytest.mark.parametrize("n", [12, 23, 30])
def test_fold_bounds_match_time_series_split(spark, n):
    k = 5
    f = sv.folds(_sup_n(spark, n), k).toPandas()
    t = n // (k + 1)
    for fold in range(1, k + 1):
        test = sorted(f[(f.fold == fold) & (f.role == "test")].i)
        train = sorted(f[(f.fold == fold) & (f.role == "train")].i)
        start = n - (k - fold + 1) * t
        assert test == list(range(start, start + t))
        assert train == list(range(0, start))
    if n == 23:
        assert sorted(f[(f.fold == 1) & (f.role == "test")].i) == [8, 9, 10]


@pytest.mark.parametrize("n", [12, 23, 30])
def test_holdout_bounds(spark, n):
    h = sv.holdout(_sup_n(spark, n)).toPandas()
    assert (h[h.role == "train"].i.max() + 1) == int(np.floor(0.8 * n))


def test_too_short_gets_no_folds(spark):
    assert sv.folds(_sup_n(spark, 5), 5).count() == 0


def test_supervised_label_is_next_return(spark, make_bars):
    closes = [100.0 + (i % 9) * 1.5 for i in range(80)]
    ind = indicator_table(make_bars(closes))
    s = sv.supervised(ind).orderBy("dt").toPandas()
    c = ind.orderBy("dt").toPandas().close
    exp = (c.pct_change().shift(-1) * 100).iloc[:-1].to_numpy()
    assert np.allclose(s.label.to_numpy(), exp) and len(s) == len(c) - 1


def test_ridge_matches_closed_form(spark, sup):
    co = M.fit("ridge", sup).coefs.toPandas().set_index("symbol")
    for sym in co.index[:2]:
        p = sup.where(F.col("symbol") == sym).toPandas()
        X_ = p[FEATURES].to_numpy()
        y = p.label.to_numpy()
        Xs = (X_ - X_.mean(0)) / X_.std(0)
        w = np.linalg.solve(Xs.T @ Xs + np.eye(len(FEATURES)), Xs.T @ (y - y.mean()))
        assert np.allclose(co.loc[sym, "w"], w, rtol=1e-6, atol=1e-8)


def test_lasso_satisfies_kkt(spark, sup):
    a = 0.001
    co = M.fit("lasso", sup).coefs.toPandas().set_index("symbol")
    sym = co.index[0]
    p = sup.where(F.col("symbol") == sym).toPandas()
    X_ = p[FEATURES].to_numpy()
    y = p.label.to_numpy()
    Xs = (X_ - X_.mean(0)) / X_.std(0)
    w = np.asarray(co.loc[sym, "w"])
    grad = Xs.T @ (y - y.mean() - Xs @ w) / len(y)
    nz = np.abs(w) > 1e-10
    assert np.allclose(grad[nz], a * np.sign(w[nz]), atol=1e-6)
    assert (np.abs(grad[~nz]) <= a + 1e-6).all()


def test_panel_ridge_matches_sklearn_scale(spark, sup):
    one = sup.where(F.col("symbol") == sup.select("symbol").first()[0]).select("symbol", "dt", "i", *FEATURES, "label")
    sym_pred = M.fit("ridge", one, scope="symbol").predict(one).orderBy("dt").toPandas().prediction
    pan_pred = M.fit("ridge", one, scope="panel").predict(one).orderBy("dt").toPandas().prediction
    assert np.allclose(sym_pred, pan_pred, rtol=1e-6, atol=1e-6 * np.abs(sym_pred).max())


def test_panel_lasso_close_to_symbol_lasso(spark, sup):
    one = sup.where(F.col("symbol") == sup.select("symbol").first()[0]).select("symbol", "dt", "i", *FEATURES, "label")
    a = M.fit("lasso", one, scope="symbol").predict(one).orderBy("dt").toPandas().prediction
    b = M.fit("lasso", one, scope="panel").predict(one).orderBy("dt").toPandas().prediction
    assert np.abs(a - b).max() <= 1e-3 * np.abs(a).max()


def test_cv_and_backtest_shapes(spark, sup):
    fm, means = M.cv_score("ridge", sup, 5)
    assert fm.count() == 5 * sup.select("symbol").distinct().count()
    bt, m, _ = M.backtest("lasso", sup)
    assert bt.count() == sup.count() - sup.groupBy("symbol").agg(
        F.floor(F.first("n") * 0.8).alias("s")).agg(F.sum("s")).first()[0]
    best = M.random_search("ridge", sup, 5, 20)[1].where("best").count()
    assert best == sup.select("symbol").distinct().count()


def test_unknown_model_lists_choices():
    with pytest.raises(ValueError, match="choose one of"):
        M.select_model("nope")


def test_grid_points_seeded_and_bounded():
    g = M.MODELS["gbt"].grid
    a, b = M.grid_points(g, 10), M.grid_points(dict(reversed(list(g.items()))), 10)
    assert a == b and len(a) == 10
    assert len(M.grid_points({"alpha": [1, 2, 3]}, 20)) == 3


def test_forest_fits_small(spark, sup):
    bt, m, _ = M.backtest("random_forest", sup, params={"numTrees": 5})
    assert bt.where(F.col("predicted").isNull()).count() == 0


def test_state_features_equal_window_features(spark):
    bars = lineitem_bars(spark, SF)
    st = fc.initial_state(bars).select("symbol", *fc.state_features(0)).toPandas().set_index("symbol").sort_index()
    ic = indicator_columns(bars.select("symbol", "dt", *OHLCV))
    from pyspark.sql import Window
    w = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    lat = ic.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("symbol", *FEATURES).toPandas()
    lat = lat.set_index("symbol").sort_index()
    a, b = st.to_numpy(dtype=float), lat.to_numpy(dtype=float)
    assert np.array_equal(np.isnan(a), np.isnan(b))
    assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=1e-12)


def test_iterative_forecast_first_step_equals_one_step(spark, sup):
    bars = lineitem_bars(spark, SF)
    m = M.fit("ridge", sup)
    it = fc.iterative_forecast(bars, m, 3).toPandas()
    assert set(it.step) == {1, 2, 3}
    live = indicator_table(bars, drop_incomplete=False)
    one = fc.one_step(live, sup, m).toPandas().set_index("symbol")
    first = it[it.step == 1].set_index("symbol")
    common = first.index.intersection(one.index)
    assert len(common) > 0
    assert np.allclose(first.loc[common, "y_hat"], one.loc[common, "y_hat"], rtol=1e-9)
    # the first forecast date is the next business day after the last bar, dates distinct
    assert it.groupby("symbol").dt.nunique().eq(3).all()


def test_price_path_compounds(spark):
    preds = spark.createDataFrame([("S", 1, 10.0), ("S", 2, -50.0), ("S", 3, 100.0)], "symbol string, step int, y_hat double")
    base = spark.createDataFrame([("S", 100.0)], "symbol string, base_price double")
    got = fc.price_path(preds, base).orderBy("step").toPandas().path_price.to_numpy()
    assert np.allclose(got, [110.0, 55.0, 110.0])


def test_segmented_price_path_equals_the_plain_one(spark):
    rows = [(s, k, float((k * 37 + len(s)) % 11 - 5) if (s, k) != ("B", 70) else -100.0) for s in ("A", "B", "CC") for k in range(1, 101)]
    rows += [("A", 101, None), ("A", 102, 1.0), ("one", 1, 2.0), ("no base", 1, 2.0)]
    preds = spark.createDataFrame(rows, "symbol string, step int, y_hat double").repartition(5)
    base = spark.createDataFrame([("A", 100.0), ("B", 10.0), ("CC", None), ("one", 1.0)], "symbol string, base_price double")
    plain = fc.price_path(preds, base).orderBy("symbol", "step")
    for size in (1, 7, 1000):
        cut = fc.price_path(preds, base, segment_rows=size)
        assert set(cut.columns) == set(plain.columns)
        assert cut.select(*plain.columns).orderBy("symbol", "step").collect() == plain.collect()
    assert fc.price_path(preds.limit(0), base, segment_rows=7).count() == 0


def test_shapley_linear_equals_exact_and_additive(spark, sup):
    m = M.fit("ridge", sup)
    lc = X.linear_contributions(m, sup).toPandas().set_index(["symbol", "feature"]).phi
    sh = X.sampled_shapley(m, sup, orders=2, background=50).toPandas()
    lc50 = X.linear_contributions(m, sup, background=50).toPandas().set_index(["symbol", "feature"]).phi
    s = sh.set_index(["symbol", "feature"]).phi
    assert np.allclose(s.reindex(lc50.index), lc50, rtol=1e-8, atol=1e-8 * lc50.abs().max())
    add = sh.groupby("symbol").agg(s=("phi", "sum"), p=("prediction", "first"), b=("base_value", "first"))
    assert np.allclose(add.s, add.p - add.b, atol=1e-8 * add.p.abs().max())
    assert len(lc) == len(s)


def test_forest_shapley_additive(spark, sup):
    m = M.fit("random_forest", sup, params={"numTrees": 5})
    sh = X.sampled_shapley(m, sup, orders=2, background=20).toPandas()
    add = sh.groupby("symbol").agg(s=("phi", "sum"), p=("prediction", "first"), b=("base_value", "first"))
    assert np.allclose(add.s, add.p - add.b, atol=1e-9)


def test_importance_constant_feature_is_zero(spark, sup):
    s = sup.withColumn("volume_ma", F.lit(5.0))
    m = M.fit("ridge", s)
    imp = X.permutation_importance(m, s, repeats=2).toPandas().set_index(["symbol", "feature"]).importance
    assert np.allclose(imp.xs("volume_ma", level="feature"), 0.0, atol=1e-12)


def test_importance_linear_closed_form_equals_generic(spark, sup):
    m = M.fit("ridge", sup, features=["price_change", "rsi"])
    a = X.permutation_importance(m, sup, repeats=2).toPandas().set_index(["symbol", "feature"]).importance
    g = M.Fitted("ridge", "symbol", m.features, coefs=None)
    g.predict = lambda df, out="prediction": linear.predict_linear(df, m.coefs, ["symbol"], m.features, out)
    b = X.permutation_importance(g, sup, repeats=2).toPandas().set_index(["symbol", "feature"]).importance
    assert np.allclose(a.sort_index(), b.sort_index(), atol=1e-12)


def test_narrative_and_net_effect(spark):
    c = spark.createDataFrame([("S", "a", 1.234, 1), ("S", "b", -0.5, 2)], "symbol string, feature string, phi double, rank int")
    n = X.narrative(c).first().narrative
    assert n == "- **a** increased the forecast by ~1.23%\n- **b** decreased the forecast by ~0.50%"
    e = X.net_effect(c).first()
    assert abs(e.net_effect - 0.734) < 1e-12 and e.bias == "bullish"


def test_analyse_end_to_end(spark):
    from candlewick.plans.analysis import analyse

    bars = lineitem_bars(spark, SF)
    out = analyse(bars, model="ridge", cv=5, days=3, refit=True)
    n_sym = bars.select("symbol").distinct().count()
    assert out["metrics"].count() == n_sym
    assert out["forecast"].count() == 3 * n_sym
    assert out["narrative"].where(F.col("narrative").isNull()).count() == 0
    assert set(out["cv_means"].columns) >= {"cv_rmse", "cv_mae", "cv_r2"}
    seg = analyse(bars, model="ridge", cv=None, days=2, explain=False, segment_rows=300)
    a = out["diagnostics"].orderBy("symbol").toPandas()
    b = seg["diagnostics"].orderBy("symbol").toPandas()
    assert np.allclose(a.predictability_score.to_numpy(dtype=float), b.predictability_score.to_numpy(dtype=float))
    assert seg["forecast"].count() == 2 * n_sym


def _several_series(make_bars):
    rng = np.random.default_rng(5)
    parts = [make_bars((100 * np.exp(np.cumsum(rng.normal(0, 0.02, 120)))).tolist(), symbol=s) for s in "ABCDEF"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_pooled_boosting_does_not_follow_the_shuffle_partitions(spark, make_bars):
    bars, found, was = _several_series(make_bars), [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (8, 30):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            bt, _, _ = M.backtest("gbt", sv.supervised(indicator_table(bars)), params={"maxIter": 4})
            found.append(sorted(map(tuple, bt.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(found[0]) > 50 and found[0] == found[1]


def test_rows_of_a_boosting_fit_are_dealt_by_their_number(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 40).selectExpr("'S' AS symbol", "id AS dt", "cast(id AS double) AS x").persist()
    few = M._dealt(rows, ["symbol"])
    assert few.rdd.getNumPartitions() == M.PANEL_PARTITIONS
    assert M._dealt(rows.coalesce(3), ["symbol"]).rdd.getNumPartitions() == 3
    monkeypatch.setattr(M, "PANEL_ROWS", 50)  # one long series is spread over all partitions
    many = M._dealt(rows, ["symbol"])
    sizes = many.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert len(sizes) == 20 and max(sizes) < 200
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) == sorted(map(tuple, rows.collect()))
    rows.unpersist()
