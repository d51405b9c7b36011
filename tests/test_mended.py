"""Grades of missing numbers, forecast status, corrections in the stream,
convergence flags, tuned training, and workers started in another folder."""

import datetime as dt
import json
import os
import subprocess
import sys
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.functions.grades import change_pct, r2_grade, rsi_state, signal
from candlewick.operators import forecast as fc
from candlewick.operators import linear
from candlewick.operators import models as M
from candlewick.operators import supervised as sv
from candlewick.operators.windows import indicator_table
from candlewick.sources.trades import lineitem_bars
from candlewick.streaming.landing import start_ingest

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_grades_of_nan_and_null(spark):
    row = spark.createDataFrame([(float("nan"), None)], "a double, b double").select(
        rsi_state(F.col("a")).alias("r"), signal(F.col("a")).alias("s"), r2_grade(F.col("a")).alias("g"), signal(F.col("b")).alias("s2"),
        change_pct(F.col("b"), F.lit(2.0)).alias("c"), change_pct(F.lit(2.0), F.lit(0.0)).alias("z"), change_pct(F.lit(3.0), F.lit(2.0)).alias("p")).first()
    assert tuple(row) == (None, None, "poor", None, None, 0.0, 50.0)


def walk(n, seed=1):
    return list(100 + np.cumsum(np.random.default_rng(seed).normal(0, 1, n)))


def test_forecast_needs_fifty_complete_bars_and_says_why(spark, make_bars):
    frames = [make_bars(walk(n), symbol=f"S{n}", volumes=list(np.random.default_rng(n).integers(500, 900, n))) for n in (49, 50, 51, 60, 90)]
    gap = walk(90, 3)
    gap[70] = None
    frames.append(make_bars(gap, symbol="GAP", volumes=list(np.random.default_rng(5).integers(500, 900, 90))))
    frames.append(make_bars(walk(90, 4), symbol="NOVOL", volumes=[None] * 90))
    bars = frames[0]
    for f in frames[1:]:
        bars = bars.unionByName(f)
    model = M.fit("ridge", sv.supervised(indicator_table(bars)))
    status = {r["symbol"]: (r["complete_bars"], r["status"]) for r in fc.forecast_status(bars, model).collect()}
    assert status["S49"] == (49, "insufficient history") and status["NOVOL"] == (0, "insufficient history")
    assert status["S50"] == (50, "no model") and status["S90"] == (90, "ok")
    rows = fc.iterative_forecast(bars, model, 3).collect()
    assert len(rows) == 3 * len(status)
    for r in rows:
        assert r["status"] == status[r["symbol"]][1]
        assert (r["price"] is not None) == (r["status"] == "ok")


def test_state_leaves_incomplete_bars_out(spark, make_bars):
    closes = walk(80)
    closes[75] = None
    st = fc.initial_state(make_bars(closes, volumes=[float(i) for i in range(80)])).collect()
    assert len(st) == 1 and None not in st[0]["closes"] and len(st[0]["closes"]) == 50


def test_reference_row_starts_from_the_processed_close(spark):
    bars = lineitem_bars(spark, SF)
    ind, live = indicator_table(bars), indicator_table(bars, drop_incomplete=False)
    sup = sv.supervised(ind)
    m = M.fit("ridge", sup)
    got = {r["symbol"]: r["current_price"] for r in fc.one_step(live, sup, m, inference_row="reference", processed=ind).collect()}
    want = {r["symbol"]: r["c"] for r in ind.groupBy("symbol").agg(F.max_by("close", "dt").alias("c")).collect()}
    assert got == want


def test_rows_without_coefficients_keep_a_null_prediction(spark):
    sup = sv.supervised(indicator_table(lineitem_bars(spark, SF)))
    m = M.fit("ridge", sup.where("symbol <> 'AF'"))
    got = {r["symbol"]: r["n"] for r in m.predict(sup).groupBy("symbol").agg(F.count("prediction").alias("n")).collect()}
    assert got["AF"] == 0 and min(v for k, v in got.items() if k != "AF") > 0


def test_lasso_says_whether_it_converged(spark):
    sup = sv.supervised(indicator_table(lineitem_bars(spark, SF)))
    feats = M.FEATURES
    good = linear.fit_linear(sup, ["symbol"], feats, "lasso", alpha=0.01, max_iter=100_000, tol=1e-6).select("iterations", "converged").collect()
    short = linear.fit_linear(sup, ["symbol"], feats, "lasso", alpha=0.01, max_iter=2).select("iterations", "converged").collect()
    assert all(r["converged"] and r["iterations"] > 0 for r in good)
    assert not any(r["converged"] for r in short) and {r["iterations"] for r in short} == {2}


def test_tuned_training_refits_with_each_symbols_best_alpha(spark):
    sup = sv.supervised(indicator_table(lineitem_bars(spark, SF)))
    _, table = M.random_search("ridge", sup, 3, 20)
    best = {r["symbol"]: r["alpha"] for r in table.where("best").collect()}
    fitted, fm, _ = M.train_model("ridge", sup, 3, tune=True)
    got = {r["symbol"]: (r["alpha"], np.array(r["w"])) for r in fitted.coefs.collect()}
    assert {k: v[0] for k, v in got.items()} == best
    for s, a in best.items():
        w = M.fit("ridge", sup.where(F.col("symbol") == s), params={"alpha": a}).coefs.first()["w"]
        assert np.allclose(got[s][1], w, rtol=1e-8, atol=1e-10)
    assert fm.count() == 3 * len(best)


def test_a_corrected_bar_replaces_the_landed_one(spark):
    root = tempfile.mkdtemp(prefix="cw-stream-")
    os.makedirs(f"{root}/landing")
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=i)).isoformat() for i in range(60)]

    def land(name, price):
        series = {d: {"1. open": str(price), "2. high": str(price), "3. low": str(price), "4. close": str(price + i), "5. volume": "10"} for i, d in enumerate(days)}
        with open(f"{root}/landing/{name}.json", "w") as f:
            f.write(json.dumps({"symbol": "S", "payload": json.dumps({"Time Series (Daily)": series})}) + "\n")
        start_ingest(spark, f"{root}/landing", f"{root}/bars", f"{root}/ind", f"{root}/ckpt").awaitTermination(300)

    land("a", 100.0)
    land("b", 50.0)  # the correction is lower
    got = spark.read.parquet(f"{root}/ind").orderBy("dt").select("open", "close").collect()
    assert got and {r["open"] for r in got} == {50.0} and got[-1]["close"] == 109.0


@pytest.mark.parametrize("names", [["ridge_one_feature", "backtest", "op3_secret_scan"]])
def test_queries_run_from_another_folder(tmp_path, names):
    """The entry module is loaded by path, without PYTHONPATH."""
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_by_path", {os.path.join(REPO, "__spark_entry__.py")!r})
e = importlib.util.module_from_spec(spec)
spec.loader.exec_module(e)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
qs = e.queries()
for name in {names!r}:
    if name in qs:
        assert qs[name](spark, {SF!r}).count() > 0, name
print("DONE")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "DONE" in out.stdout, out.stderr[-2000:]


def test_missing_volumes_are_imputed_or_left_out(spark, make_bars):
    vol = [None if i % 45 == 44 else float(500 + i * 7 % 90) for i in range(140)]
    bars = make_bars(walk(140), symbol="A", volumes=vol).unionByName(make_bars(walk(140, 2), symbol="NOVOL", volumes=[None] * 140))
    sup = sv.supervised(indicator_table(bars, require_volume=False))
    m = M.fit("ridge", sup, impute="median")
    coefs = {r["symbol"]: r for r in m.coefs.collect()}
    feats = M.FEATURES
    x = sup.where("symbol = 'A'").toPandas()
    v = x[feats].astype(float)
    v = v.fillna(v.median()).fillna(0.0).to_numpy()
    sd = v.std(axis=0)
    sd[sd < 1e-12] = 1.0
    z = (v - v.mean(axis=0)) / sd
    want = np.linalg.solve(z.T @ z + np.eye(len(feats)), z.T @ (x.label - x.label.mean()).to_numpy())
    assert np.allclose(coefs["A"]["w"], want, rtol=1e-6, atol=1e-8)
    w = np.array(coefs["NOVOL"]["w"])
    assert np.isfinite(w).all() and w[feats.index("volume")] == 0 and w[feats.index("volume_ma")] == 0
    assert m.predict(sup).where("prediction IS NULL OR isnan(prediction)").count() == 0
    plain = M.fit("ridge", sup).coefs.collect()  # rows with a gap are left out, so NOVOL has no model
    assert [r["symbol"] for r in plain] == ["A"] and plain[0]["n"] == int(x[feats].notna().all(axis=1).sum())


def test_walk_forward_statistics_equal_a_fit_per_fold(spark):
    sup = sv.supervised(indicator_table(lineitem_bars(spark, SF)))
    got = {(r["symbol"], r["fold"]): r for r in linear.fit_walk_forward(sv.blocks(sup, 3), ["symbol"], M.FEATURES, 3, "ridge", [1.0]).collect()}
    f = sv.folds(sup, 3).where("role = 'train'")
    want = {(r["symbol"], r["fold"]): r for r in linear.fit_linear(f, ["symbol", "fold"], M.FEATURES).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert got[k]["n"] == r["n"] and np.allclose(got[k]["w"], r["w"], rtol=1e-9, atol=1e-10)


def test_cross_validation_copies_no_rows(spark):
    sup = sv.supervised(indicator_table(lineitem_bars(spark, SF)))
    plan = M.cv_score("ridge", sup)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_vectorised_path_features_equal_the_window_features(spark):
    """Both inference rows, on the last bars of every symbol."""
    bars = lineitem_bars(spark, SF)
    for off in (0, 2):
        st = fc.initial_state(bars, fc.STATE_CLOSES + off).select("*", *fc.state_features(off)).toPandas()
        held = {k: np.stack(st[k].to_list()).astype(float) for k in ("closes", "volumes", "opens", "highs", "lows")}
        end = -off or None
        got = fc._numpy_features(held["closes"][:, :end], held["volumes"][:, :end], tuple(held[k][:, -1 - off] for k in ("opens", "highs", "lows")))
        want = st[M.FEATURES].to_numpy(dtype=float)
        assert np.array_equal(np.isnan(got), np.isnan(want))
        assert np.allclose(got, want, rtol=1e-9, equal_nan=True)
