"""The lasso's homotopy path against coordinate descent, and its corners."""

import numpy as np
import pytest

from candlewick.operators import linear

FEATS = ["a", "b", "c", "d"]
SCHEMA = "symbol string, a double, b double, c double, d double, label double"


def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, noise in (("S", 1.0), ("Q", 0.1)):
        x = rng.standard_normal((120, 4))
        x[:, 1] = 0.95 * x[:, 0] + 0.3 * x[:, 1]  # correlated, so that coefficients cross zero
        x[:, 3] = 7.0 if s == "Q" else x[:, 3]  # a constant feature
        y = x[:, 0] - 0.8 * x[:, 1] + 0.3 * x[:, 2] + noise * rng.standard_normal(120)
        rows += [(s, *map(float, v), float(t)) for v, t in zip(x, y)]
    return spark.createDataFrame(rows, SCHEMA)


def descent(g, alpha):
    x, y = g[FEATS].to_numpy(), g["label"].to_numpy()
    sd = x.std(axis=0)
    z, r, w = (x - x.mean(axis=0)) / np.where(sd < 1e-9, 1.0, sd), y - y.mean(), np.zeros(4)
    for _ in range(4000):
        for j in range(4):
            if z[:, j] @ z[:, j] > 1e-9:
                rho = z[:, j] @ (r - z @ w + z[:, j] * w[j]) / len(y)
                w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (z[:, j] @ z[:, j] / len(y))
    return w


def test_path_equals_coordinate_descent(spark):
    df, alphas = data(spark), [5.0, 0.5, 0.2, 0.05, 0.01, 0.001]
    got = linear.lasso_path(df, ["symbol"], FEATS, alphas).collect()
    assert len(got) == 2 * len(alphas)
    groups = dict(list(df.toPandas().groupby("symbol")))
    for r in got:
        assert np.allclose(r["w"], descent(groups[r["symbol"]], r["alpha"]), atol=1e-7)
        assert abs(r["gap"]) < 1e-10 and r["excess"] < 1e-10
        assert any(r["w"]) == (r["alpha"] < r["alpha_max"])


def test_path_equals_the_fitted_lasso(spark):
    df = data(spark)
    path = {r["symbol"]: r for r in linear.lasso_path(df, ["symbol"], FEATS, [0.001]).collect()}
    for r in linear.fit_linear(df, ["symbol"], FEATS, "lasso", 0.001).collect():
        assert np.allclose(r["w"], path[r["symbol"]]["w"], atol=1e-7) and r["mu"] == path[r["symbol"]]["mu"]


def test_corners_are_where_the_active_set_changes(spark):
    rows = linear.lasso_path(data(spark), ["symbol"], FEATS, least=1e-3).orderBy("symbol", "alpha").collect()
    for s in ("S", "Q"):
        mine = [r for r in rows if r["symbol"] == s][::-1]
        assert mine[0]["alpha"] == mine[0]["alpha_max"] and not any(mine[0]["w"])
        assert mine[-1]["alpha"] == pytest.approx(1e-3)
        assert all(x["alpha"] > y["alpha"] for x, y in zip(mine, mine[1:]))
        assert all(abs(r["gap"]) < 1e-10 and r["excess"] < 1e-10 for r in mine)
        if s == "Q":
            assert all(r["w"][3] == 0 for r in mine)


def test_constant_label_and_empty_table(spark):
    flat = spark.createDataFrame([("S", float(i), 1.0, 2.0, float(i % 3), 4.0) for i in range(9)], SCHEMA)
    (r,) = linear.lasso_path(flat, ["symbol"], FEATS, [0.1]).collect()
    assert not any(r["w"]) and r["alpha_max"] == pytest.approx(0.0, abs=1e-12)
    assert linear.lasso_path(spark.createDataFrame([], SCHEMA), ["symbol"], FEATS, [0.1]).count() == 0
