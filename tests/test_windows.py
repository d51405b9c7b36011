import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from candlewick.operators import windows as win
from candlewick.schema import INDICATORS, OHLCV


def indicators_by_definition(close, volume):
    """Every indicator of every row, written out from its definition: plain
    loops over the rows of each window, nan where the window is not full."""
    n = len(close)

    def rows(size, t):
        return range(t - size + 1, t + 1)

    def change(t, lag=1):
        return close[t] / close[t - lag] - 1 if t >= lag else math.nan

    def log_step(t):
        return math.log(close[t] / close[t - 1]) if t >= 1 else math.nan

    def mean(values):
        return math.fsum(values) / len(values)

    def spread(values):
        m = mean(values)
        return math.sqrt(math.fsum((v - m) ** 2 for v in values) / (len(values) - 1))

    def window(t, size, value, first=0):
        """The values of a full window, or None; ``first`` is the first row that has a value."""
        return [value(j) for j in rows(size, t)] if t - size + 1 >= first else None

    def strength(t):
        if t < 13:  # the first row has no move and counts as none
            return math.nan
        moves = [close[j] - close[j - 1] if j else 0.0 for j in rows(14, t)]
        up, down = sum(m for m in moves if m > 0), sum(-m for m in moves if m < 0)
        return 100 * up / (up + down) if up + down else math.nan

    out = {name: np.full(n, math.nan) for name in INDICATORS}
    for t in range(n):
        for size in (20, 50):
            if w := window(t, size, close.__getitem__):
                out[f"ma_{size}"][t] = mean(w)
                if size == 20:
                    out["z_20"][t] = (close[t] - mean(w)) / (spread(w) + 1e-9)
        for size in (5, 20):
            if w := window(t, size, log_step, first=1):
                out[f"vol_{size}"][t] = spread(w)
        if w := window(t, 10, volume.__getitem__):
            out["volume_ma"][t] = mean(w)
        out["rsi"][t], out["price_change"][t], out["log_return"][t], out["mom_5"][t] = strength(t), change(t), log_step(t), change(t, 5)
        for lag in (1, 2, 3, 5):
            if t >= lag:
                out[f"close_lag_{lag}"][t], out[f"ret_lag_{lag}"][t] = close[t - lag], change(t - lag)
        if t + 1 < n:
            out["fwd_return_1d"][t], out["fwd_price_1d"][t] = 100 * change(t + 1), close[t + 1]
    return out


def test_indicators_match_their_definitions(spark, make_bars):
    rng = np.random.default_rng(7)
    close = list(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 150))))
    vol = list(rng.integers(100, 1000, 150).astype(float))
    got = win.indicator_columns(make_bars(close, volumes=vol).select("symbol", "dt", *OHLCV)).orderBy("dt").toPandas()
    exp = indicators_by_definition(close, vol)
    for c in INDICATORS:
        a, b = got[c].to_numpy(dtype=float), np.asarray(exp[c], dtype=float)
        assert np.array_equal(np.isnan(a), np.isnan(b)), c
        assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=1e-9, atol=1e-9), c


def test_constant_close_rsi_null(spark, make_bars):
    r = win.with_rsi(make_bars([10.0] * 60)).select("rsi").toPandas().rsi
    assert r.isna().all()


def test_rising_close_rsi_100(spark, make_bars):
    r = win.with_rsi(make_bars([float(i) for i in range(1, 61)])).orderBy("dt").toPandas().rsi
    assert (r.dropna() == 100.0).all() and r.notna().sum() == 60 - 13


def test_rsi_appears_on_14th_row(spark, make_bars):
    for n in (13, 14, 15):
        r = win.with_rsi(make_bars([float(i % 5 + 1) for i in range(n)])).orderBy("dt").toPandas().rsi
        assert r.notna().sum() == max(0, n - 13)
        if n >= 14:
            assert r.iloc[:13].isna().all() and r.iloc[13:].notna().all()


def test_ma50_warm_up(spark, make_bars):
    for n, complete in ((49, 0), (50, 0), (51, 1)):
        closes = [100.0 + (i % 7) for i in range(n)]
        assert win.indicator_table(make_bars(closes)).count() == complete


def test_one_missing_close(spark, make_bars):
    closes = [100.0 + (i % 7) for i in range(120)]
    closes[60] = None
    ma = win.with_sma(make_bars(closes), 50).orderBy("dt").toPandas().ma_50
    assert ma.iloc[60:110].isna().all() and ma.iloc[110:].notna().all() and ma.iloc[49:60].notna().all()


def test_missing_volume(spark, make_bars):
    closes = [100.0 + (i % 7) for i in range(120)]
    b = make_bars(closes, volumes=[None] * 120)
    assert win.indicator_table(b).count() == 0
    assert win.indicator_table(b, require_volume=False).count() == 120 - 49 - 1


def test_zero_and_negative_close_never_inf(spark, make_bars):
    closes = [100.0, 0.0, -5.0, 50.0] * 15
    d = win.indicator_columns(make_bars(closes).select("symbol", "dt", *OHLCV)).toPandas()
    vals = d[INDICATORS].to_numpy(dtype=float)
    assert not np.isinf(vals).any()


def test_many_symbols_equal_union_of_single(spark, make_bars):
    rng = np.random.default_rng(1)
    a = make_bars(list(100 + rng.normal(0, 1, 80).cumsum()), "A")
    b = make_bars(list(50 + rng.normal(0, 1, 90).cumsum()), "B")
    both = win.indicator_table(a.unionByName(b)).orderBy("symbol", "dt").toPandas()
    single = pd.concat([win.indicator_table(a).toPandas(), win.indicator_table(b).toPandas()])
    single = single.sort_values(["symbol", "dt"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(both, single)


def test_independent_of_shuffle_partitions(spark, make_bars):
    rng = np.random.default_rng(2)
    b = make_bars(list(100 + rng.normal(0, 1, 80).cumsum()), "A")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        x = win.indicator_table(b).orderBy("dt").toPandas()
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        y = win.indicator_table(b).orderBy("dt").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    pd.testing.assert_frame_equal(x, y)


def test_plan_has_one_exchange(spark, make_bars):
    b = make_bars([float(i) for i in range(60)])
    plan = win.indicator_table(b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_latest_change(spark, make_bars):
    r = win.latest_change(make_bars([10.0, 12.0, 9.0])).first()
    assert r["last"] == 9.0 and r["prev"] == 12.0 and math.isclose(r["change_pct"], -25.0)


def test_constant_close_diagnostics_null_score(spark, make_bars):
    from candlewick.operators import stats

    d = stats.diagnostics(make_bars([10.0] * 60)).first()
    assert d.ret_autocorr_lag1 is None and d.predictability_score is None
    assert stats.WARN_CONSTANT in d.warnings and d.ret_var == 0.0


def test_diagnostics_short_series_defaults(spark, make_bars):
    from candlewick.operators import stats

    d = stats.diagnostics(make_bars([10.0, 11.0, 12.0, 11.0, 10.5])).first()
    assert d.ret_autocorr_lag1 == 0.0 and d.rows == 5 and stats.WARN_SHORT in d.warnings


def test_segmented_equals_plain_with_tiny_segments(spark, make_bars):
    rng = np.random.default_rng(3)
    a = make_bars(list(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 400)))), "A")
    b = make_bars(list(50 * np.exp(np.cumsum(rng.normal(0, 0.02, 130)))), "B")
    bars = a.unionByName(b)
    plain = win.indicator_table(bars).orderBy("symbol", "dt").toPandas()
    seg = win.indicator_table(bars, segment_rows=60).orderBy("symbol", "dt").toPandas()
    pd.testing.assert_frame_equal(plain, seg)
    from candlewick.operators import supervised as sv

    ind = win.indicator_table(bars)
    p = sv.supervised(ind, 2).orderBy("symbol", "dt").toPandas()
    s = sv.supervised(ind, 2, segment_rows=60).orderBy("symbol", "dt").toPandas()
    pd.testing.assert_frame_equal(p, s)


def test_segmented_positions_on_timestamps(spark):
    import datetime as dt

    from candlewick.operators import segments

    rows = [("S", dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, close double")
    pos = segments.with_positions(df).orderBy("dt").toPandas()
    assert list(pos._pos) == list(range(300)) and (pos._n == 300).all()
    seg = segments.segment(segments.with_positions(df), 100, back=5, fwd=1)
    counts = seg.groupBy("_seg").count().orderBy("_seg").toPandas()["count"].tolist()
    assert counts == [101, 106, 105]


def test_history_status(spark, make_bars):
    from candlewick.operators import stats

    short = make_bars([1.0 + (i % 3) for i in range(30)], "SHORT")
    ok = make_bars([100.0 + (i % 7) for i in range(120)], "OK")
    bars = short.unionByName(ok)
    st = {r.symbol: r.status for r in stats.history_status(bars, win.indicator_table(bars)).collect()}
    assert st == {"SHORT": "insufficient_history", "OK": "ok"}


def test_segmented_statistics_equal_plain(spark, make_bars):
    from candlewick.operators import stats

    rng = np.random.default_rng(5)
    a = make_bars(list(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))), "A")
    b = make_bars(list(50 * np.exp(np.cumsum(rng.normal(0, 0.02, 90)))), "B")
    bars = a.unionByName(b)
    for fn in (stats.diagnostics, stats.volatility, stats.table_stats):
        x = fn(bars).orderBy("symbol").toPandas()
        y = fn(bars, segment_rows=40).orderBy("symbol").toPandas()
        num = x.select_dtypes("number").columns
        assert np.allclose(x[num].to_numpy(dtype=float), y[num].to_numpy(dtype=float), rtol=1e-12, equal_nan=True)
