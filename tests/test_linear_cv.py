"""Fold metrics from the parts, imputation inside folds."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators import linear
from candlewick.operators import metrics as met
from candlewick.operators import models as M
from candlewick.operators import supervised as sv

FEATS = ["a", "b", "c"]


def data(spark, holes, n=90, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("S", "Q"):
        x = rng.standard_normal((n, 3)) * [1, 100, 0.01] + [0, 1000, 5]
        y = x @ [1, 0.02, 30] + rng.standard_normal(n)
        gone = rng.random((n, 3)) < (0.2 if holes else 0)
        rows += [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), i, n, *[None if g else float(v) for g, v in zip(gone[i], x[i])], float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, dt date, i int, n int, a double, b double, c double, label double")


def plain(df, k, model, alpha, fill):
    """Fold metrics per symbol by numpy, one fold after the other."""
    out = {}
    for s, g in df.toPandas().sort_values("i").groupby("symbol"):
        x, y, n = g[FEATS].to_numpy(float), g["label"].to_numpy(), len(g)
        t = n // (k + 1)
        for f in range(1, k + 1):
            a = n - (k - f + 1) * t
            tr_, te, yt = x[:a], x[a:a + t], y[:a]
            values = (np.nanmedian if fill == "median" else np.nanmean)(tr_, axis=0)
            tr_, te = (np.where(np.isnan(v), values, v) for v in (tr_, te))
            mu, sd = tr_.mean(axis=0), tr_.std(axis=0)
            z, w = (tr_ - mu) / sd, np.zeros(3)
            if model == "ridge":
                w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (yt - yt.mean()))
            else:
                for _ in range(3000):
                    for j in range(3):
                        rho = z[:, j] @ (yt - yt.mean() - z @ w + z[:, j] * w[j]) / a
                        w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (z[:, j] @ z[:, j] / a)
            e = y[a:a + t] - yt.mean() - (te - mu) / sd @ w
            out[s, f] = (t, np.sqrt((e**2).mean()), abs(e).mean(), 1 - (e**2).sum() / ((y[a:a + t] - y[a:a + t].mean()) ** 2).sum())
    return out


@pytest.mark.parametrize("model,alpha,impute", [("ridge", 1.0, None), ("ridge", 1.0, "median"), ("lasso", 0.001, "mean"), ("lasso", 0.001, "median")])
def test_fold_metrics_equal_plain_ones(spark, model, alpha, impute):
    df = data(spark, impute is not None)
    fm, means = M.cv_score(model, df, 5, FEATS, impute=impute)
    want = plain(df, 5, model, alpha, impute)
    got = {(r["symbol"], r["fold"]): (r["n"], r["rmse"], r["mae"], r["r2"]) for r in fm.collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-7)
    pred = M.cv_predictions(model, df, 5, FEATS, impute=impute)
    again = {(r["symbol"], r["fold"]): (r["n"], r["rmse"], r["mae"], r["r2"]) for r in met.regression_metrics(pred, ["symbol", "fold"]).collect()}
    for key in want:
        assert again[key] == pytest.approx(want[key], rel=1e-7)


def test_errors_without_a_broadcast_are_the_same(spark, monkeypatch):
    df = data(spark, True, seed=1)
    want = {tuple(r)[:3]: r["mae"] for r in M.linear_cv("ridge", df, 3, [0.1, 10.0], FEATS, "median").collect()}
    monkeypatch.setattr(linear, "HELD_NUMBERS", 0)
    got = {tuple(r)[:3]: r["mae"] for r in M.linear_cv("ridge", df, 3, [0.1, 10.0], FEATS, "median").collect()}
    assert got == pytest.approx(want) and len(got) == 12


def test_fills_know_earlier_blocks_only_and_features_never_seen(spark):
    df = data(spark, True, seed=2).withColumn("c", F.when(F.col("i") >= 60, F.col("c")))
    rows = sv.blocks(df, 5)
    fills = {(r["symbol"], r["fold"]): r["fill"] for r in linear.fold_fills(rows, ["symbol"], FEATS, 5).collect()}
    pdf = rows.toPandas()
    for (s, f), fill in fills.items():
        x = pdf[(pdf["symbol"] == s) & (pdf["fold"] < f)][FEATS]
        assert [v for v in fill if v is not None] == pytest.approx(x.median().dropna().tolist())
    assert fills["S", 1][2] is None and fills["S", 5][2] is not None
    fm, _ = M.cv_score("ridge", df, 5, FEATS, impute="median")
    assert fm.count() == 10 and fm.where("rmse is null or isnan(rmse)").count() == 0


def test_imputation_in_search_training_and_back_test(spark):
    df = data(spark, True, seed=3)
    _, table = M.random_search("ridge", df, 3, features=FEATS, impute="median")
    assert table.where("best").count() == 2 and table.count() == 6
    fitted, fm, _ = M.train_model("ridge", df, 3, tune=True, features=FEATS, impute="median")
    assert fm.count() == 6 and fitted.predict(df).where("prediction is null").count() == 0
    bt, m, _ = M.backtest("lasso", df, features=FEATS, impute="mean")
    assert m.agg(F.sum("n")).first()[0] == bt.count() == 36
    with pytest.raises(ValueError):
        M.cv_score("gbt", df, 3, FEATS, impute="median")
