"""Trees per group against plain numpy ones, and cut-up groups against whole ones."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators import models as M
from candlewick.operators import trees as tr

FEATS = ["a", "b", "c"]


def data(spark, n=240, symbols=("S", "Q"), seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        x = rng.integers(-10, 11, (n, 3)) / 10  # few values, so that every value is an edge
        y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1] ** 2 + 0.1 * rng.standard_normal(n)
        rows += [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), i, n, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, dt date, i int, n int, a double, b double, c double, label double")


def plain_tree(x, y, w, depth, least, ok=None):
    """Exhaustive least-squares splits at midpoints: (feature, left values, value) nested."""
    value = (w * y).sum() / w.sum()
    best = None
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                if w[left].sum() >= least and w[~left].sum() >= least:
                    gain = sum((w[m] * y[m]).sum() ** 2 / w[m].sum() for m in (left, ~left)) - (w * y).sum() ** 2 / w.sum()
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, cut)
    if best is None or best[0] <= 1e-9:
        return value
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], plain_tree(x[left], y[left], w[left], depth - 1, least), plain_tree(x[~left], y[~left], w[~left], depth - 1, least))


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def arrays(df, symbol="S"):
    pdf = df.where(F.col("symbol") == symbol).orderBy("i").toPandas()
    return pdf[FEATS].to_numpy(), pdf["label"].to_numpy()


def models_of(df, params, **kw):
    return tr.fit_trees(tr.packed(df, ["symbol"], FEATS, **kw), ["symbol"], [tr.Job(0, 0, params)])


def predictions(df, models):
    pdf = tr.predict_trees(df, models, ["symbol"], FEATS).orderBy("symbol", "i").toPandas()
    return pdf["prediction"].to_numpy(float)


def test_one_tree_equals_a_plain_one(spark):
    df = data(spark)
    x, y = arrays(df)
    got = predictions(df.where("symbol = 'S'"), models_of(df, tr.TreeParams(boost=False, trees=1, depth=4, min_weight=5)))
    tree = plain_tree(x, y, np.ones(len(y)), 4, 5)
    assert np.allclose(got, [walk(tree, r) for r in x], atol=1e-9)


def test_a_forest_equals_plain_trees_on_its_draws(spark):
    df = data(spark, seed=1)
    x, y = arrays(df)
    p = tr.TreeParams(boost=False, trees=4, depth=3, min_weight=5, bootstrap=True)
    want = np.zeros(len(y))
    for t in range(4):
        w = tr.row_weights(p, t, np.arange(len(y)))
        assert 0.8 < w.mean() < 1.2 and w.max() > 1
        tree = plain_tree(x[w > 0], y[w > 0], w[w > 0], 3, 5)
        want += [walk(tree, r) for r in x]
    assert np.allclose(predictions(df.where("symbol = 'S'"), models_of(df, p)), want / 4, atol=1e-9)


def test_boosting_equals_plain_trees_on_residuals(spark):
    df = data(spark, seed=2)
    x, y = arrays(df)
    p = tr.TreeParams(boost=True, trees=5, depth=2, min_weight=10, rate=0.3, rows=0.8)
    score = np.full(len(y), y.mean())
    for t in range(5):
        w = tr.row_weights(p, t, np.arange(len(y)))
        tree = plain_tree(x[w > 0], (y - score)[w > 0], w[w > 0], 2, 10)
        score = score + 0.3 * np.array([walk(tree, r) for r in x])
    assert np.allclose(predictions(df.where("symbol = 'S'"), models_of(df, p)), score, atol=1e-9)


def test_regularised_leaves_equal_a_direct_computation(spark):
    df = data(spark, seed=3).where("symbol = 'S'")
    x, y = arrays(df)
    p = tr.TreeParams(boost=True, trees=1, depth=1, min_weight=30, l1=20.0, l2=7.0)
    r = models_of(df, p).first()
    f, cut = r["feature"][0], r["threshold"][0]
    left = x[:, f] <= cut
    g = y - r["init"]

    def soft(v):
        return np.sign(v) * max(abs(v) - 20.0, 0.0)

    assert r["value"][1:3] == pytest.approx([soft(g[m].sum()) / (m.sum() + 7.0) for m in (left, ~left)], abs=1e-9)
    gains = {}
    for k in range(3):
        for c in np.unique(x[:, k])[:-1]:
            m = x[:, k] <= c
            if min(m.sum(), (~m).sum()) >= 30:
                gains[k, c] = sum(soft(g[s].sum()) ** 2 / (s.sum() + 7.0) for s in (m, ~m)) - soft(g.sum()) ** 2 / (len(g) + 7.0)
    assert gains[f, cut] == pytest.approx(max(gains.values())) and r["gain"][0] == pytest.approx(max(gains.values()))


@pytest.mark.parametrize("params", [
    tr.TreeParams(boost=False, trees=10, depth=3, min_weight=3, bootstrap=True, node_features="sqrt"),
    tr.TreeParams(boost=True, trees=30, depth=2, rate=0.1, rows=0.7, tree_features=0.7, l1=0.1, l2=1.0)])
def test_a_group_cut_into_chunks_gives_the_same_model(spark, params):
    df = data(spark, n=90, seed=4)
    whole = {r["symbol"]: r for r in models_of(df, params).collect()}
    apart = {r["symbol"]: r for r in models_of(df, params, chunk=25).collect()}
    for s in ("S", "Q"):
        assert whole[s]["feature"] == apart[s]["feature"] and whole[s]["threshold"] == apart[s]["threshold"]
        assert whole[s]["weight"] == apart[s]["weight"] and whole[s]["value"] == pytest.approx(apart[s]["value"], abs=1e-12)


def test_column_shares(spark):
    p = tr.TreeParams(boost=True, trees=1, depth=1, tree_features=0.4)
    assert tr.allowed_features(p, 3, 0, 2, 10).sum(axis=1).tolist() == [4, 4]
    assert (tr.allowed_features(p, 3, 0, 2, 10)[0] == tr.allowed_features(p, 3, 0, 2, 10)[1]).all()
    q = tr.TreeParams(boost=False, trees=1, depth=1, node_features="sqrt")
    ok = tr.allowed_features(q, 3, 7, 50, 16)
    assert (ok.sum(axis=1) == 4).all() and len({tuple(r) for r in ok.tolist()}) > 20


def test_folds_train_on_earlier_blocks_only(spark):
    df = data(spark, n=120, seed=5)
    pred = M.cv_predictions("gbt", df, 5, FEATS, "symbol", {"trees": 3}).toPandas()
    assert len(pred) == 2 * 5 * 20 and pred.groupby(["symbol", "fold"]).size().eq(20).all()
    one = M.fit("gbt", df.where("i < 60"), FEATS, "symbol", params={"trees": 3})
    # the bins come from all rows of the symbol, so cut the same rows the same way
    want = pred[pred["fold"] == 3].sort_values(["symbol", "dt"])
    data_ = tr.packed(df.withColumn("fold", F.when(F.col("i") < 60, 0).otherwise(F.when(F.col("i") < 80, 1).otherwise(2))), ["symbol"], FEATS, block="fold")
    got = tr.score_blocks(data_, tr.fit_trees(data_, ["symbol"], [tr.Job(0, 1, M.tree_params("gbt", {"trees": 3}))]), ["symbol"]).toPandas().sort_values(["symbol", "dt"])
    assert np.allclose(got["prediction"], want["prediction"], atol=1e-12) and one.predict(df).count() == 240


def test_missing_values_and_unknown_groups(spark):
    df = data(spark, n=40, seed=6)
    gaps = df.withColumn("a", F.when(F.col("i") % 7 != 0, F.col("a"))).withColumn("label", F.when(F.col("i") % 11 != 0, F.col("label")))
    m = models_of(gaps, tr.TreeParams(boost=False, trees=2, depth=2))
    assert {r["train_rows"] for r in m.collect()} == {len([i for i in range(40) if i % 7 and i % 11])}
    other = gaps.withColumn("symbol", F.when(F.col("i") < 5, "new").otherwise(F.col("symbol")))
    pdf = tr.predict_trees(other, m, ["symbol"], FEATS).toPandas()
    assert pdf.loc[(pdf["symbol"] == "new") | pdf["a"].isna(), "prediction"].isna().all() and pdf["prediction"].notna().sum() == 60
    assert models_of(df.limit(0), tr.TreeParams(boost=False, trees=2, depth=2)).count() == 0


def test_models_too_large_to_broadcast_meet_rows_by_salt(spark, monkeypatch):
    df = data(spark, n=60, seed=7)
    m = models_of(df, tr.TreeParams(boost=True, trees=4, depth=2))
    want = predictions(df, m)
    monkeypatch.setattr(tr, "BROADCAST_NODES", 1)
    assert np.array_equal(predictions(df, m), want)


def test_search_scores_every_point(spark):
    df = data(spark, n=120, seed=8)
    _, table = M.random_search("gbt_large", df, 3, 3, features=FEATS, scope="symbol")
    rows = table.collect()
    assert len(rows) == 6 and sum(r["best"] for r in rows) == 2 and all(r["folds"] == 3 and "l1" in r["params"] for r in rows)
    for s in ("S", "Q"):
        mine = [r for r in rows if r["symbol"] == s]
        assert min(mine, key=lambda r: (r["cv_rmse"], r["point"]))["best"]


def subset_values(predict, x, background):
    """Shapley values by all subsets."""
    from itertools import combinations
    from math import factorial

    p = len(x)

    def worth(keep):
        rows = background.copy()
        rows[:, list(keep)] = x[list(keep)]
        return predict(rows).mean()

    out = np.zeros(p)
    for j in range(p):
        rest = [k for k in range(p) if k != j]
        for size in range(p):
            for s in combinations(rest, size):
                out[j] += factorial(size) * factorial(p - size - 1) / factorial(p) * (worth((*s, j)) - worth(s))
    return out


@pytest.mark.parametrize("params", [tr.TreeParams(boost=False, trees=6, depth=4, bootstrap=True, min_weight=2),
                                    tr.TreeParams(boost=True, trees=8, depth=3, rate=0.2, l2=1.0)])
def test_tree_contributions_equal_all_subsets(params):
    rng = np.random.default_rng(1)
    n, p = 150, 6
    bins = rng.integers(0, 12, (n, p)).astype(np.uint8)
    y = bins[:, 0] * 0.5 + (bins[:, 1] > 5) * bins[:, 2] + rng.standard_normal(n)
    rows = tr.Rows(np.arange(n), np.zeros(n, int), y, bins, n, float(abs(y).max()), np.full(p, 12))
    edges = [list(np.arange(12.0))] * p
    names = tr._fields([]).names
    model = tr.Flat(dict(zip(names, tr._model_row((), tr.Job(0, 0, params), tr.grown(rows, tr.Job(0, 0, params)), edges, n))))
    x, back = bins[0].astype(float), bins[20:50].astype(float)
    from candlewick.operators.explain import tree_contributions

    phi = tree_contributions(model, x, back)
    assert np.allclose(phi, subset_values(model.predict, x, back), atol=1e-9)
    assert phi.sum() + model.predict(back).mean() == pytest.approx(model.predict(x[None])[0], abs=1e-9)


def test_tree_forecast_equals_step_by_step(spark, make_bars):
    from candlewick.operators import forecast as fc
    from candlewick.operators import supervised as sv
    from candlewick.operators.windows import indicator_table

    rng = np.random.default_rng(2)
    closes = (100 * np.exp(np.cumsum(rng.standard_normal(140) / 50))).tolist()
    bars = make_bars(closes, volumes=rng.uniform(1, 9, 140).tolist()).unionByName(make_bars(closes[:20], symbol="short"))
    model = M.fit("random_forest", sv.supervised(indicator_table(bars)), scope="symbol", params={"trees": 5})
    got = fc.iterative_forecast(bars, model, 4).orderBy("symbol", "step").toPandas()
    assert got[got["symbol"] == "short"]["y_hat"].isna().all() and (got[got["symbol"] == "short"]["status"] == "insufficient history").all()
    held = bars.where("symbol = 'S'")
    for step in range(1, 5):
        last = indicator_table(held, drop_incomplete=False).orderBy(F.col("dt").desc()).limit(1)
        row = model.predict(last.select("symbol", "dt", "close", "volume", *[c for c in M.FEATURES if c not in ("volume",)])).first()
        mine = got[(got["symbol"] == "S") & (got["step"] == step)].iloc[0]
        assert mine["y_hat"] == pytest.approx(row["prediction"], abs=1e-9)
        new = row["close"] * (1 + row["prediction"] / 100)
        assert mine["price"] == pytest.approx(new, rel=1e-12)
        held = held.unionByName(spark.createDataFrame([("S", row["dt"] + dt.timedelta(days=1), new, new * 1.01, new * 0.99, new, row["volume"], "test")], held.schema))
