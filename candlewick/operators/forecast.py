"""Forecasts: one step, iterative multi-step, dates, price path, signals.

The iterative forecast keeps one state row per symbol -- the last 50 closes
(two more for the reference's inference row) and 12 volumes of complete bars
as arrays plus the last open/high/low -- and
recomputes the 22 features from the arrays.  A linear model runs all steps in
one vectorised pass over batches of state rows (a row is of fixed size, no
shuffle, no checkpoint); so do trees per symbol, each state row with its model's
node arrays.  A panel model is scored by Spark ML step by step: the
features come from Spark's higher-order functions, one step is a narrow
projection plus ``model.transform``, and the lineage is cut with
``checkpoint()`` every few steps.  Predictions accumulate in array columns of
the state and are exploded once at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.calendar import business_days_after
from candlewick.functions.grades import change_pct, price_from_return, signal
from candlewick.operators import trees
from candlewick.operators.models import Fitted
from candlewick.operators.segments import with_positions
from candlewick.schema import FEATURES, LAGS, OHLCV
from candlewick.session import ensure_checkpoint_dir

STATE_CLOSES = 50   # MA_50; the reference's inference row lags two more
STATE_VOLUMES = 12
# The placeholder bar appended after each predicted close.
HIGH_FACTOR, LOW_FACTOR = 1.01, 0.99


# --- features from the state arrays ----------------------------------------------

def _el(arr: str, i: int, off: int) -> Column:
    """i-th latest element (1 = latest) after dropping ``off`` newest elements."""
    return F.element_at(F.col(arr), -(i + off))


def _window_vals(arr: str, k: int, off: int) -> Column:
    return F.slice(F.col(arr), -(k + off), k)


def _full_avg(vals: Column, k: int) -> Column:
    ok = (F.size(F.filter(vals, lambda x: x.isNotNull())) == k)
    total = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(ok, total / F.lit(float(k)))


def _full_std(vals: Column, k: int) -> Column:
    ok = (F.size(F.filter(vals, lambda x: x.isNotNull())) == k)
    mean = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x) / F.lit(float(k))
    ss = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(ok, F.sqrt(ss / F.lit(float(k - 1))))


def _ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def state_features(off: int = 0) -> list[Column]:
    """The 22 features (same definitions as the window operators) of the bar
    ``off`` rows before the newest one in the state arrays."""
    c1, c2 = _el("closes", 1, off), _el("closes", 2, off)
    n = F.size(F.col("closes")) - F.lit(off)

    def lr_vals(k: int) -> Column:
        idx = F.sequence(n - F.lit(k - 1), n)
        return F.transform(idx, lambda i: _ln(F.element_at("closes", i)) - _ln(F.element_at("closes", i - 1)))

    deltas = F.transform(F.sequence(n - F.lit(13), n),
                         lambda i: F.element_at("closes", i) - F.element_at("closes", i - 1))
    gains = F.transform(deltas, lambda d: F.when(d > 0, d).otherwise(F.lit(0.0)))
    losses = F.transform(deltas, lambda d: F.when(d < 0, -d).otherwise(F.lit(0.0)))
    g, lo = _full_avg(gains, 14), _full_avg(losses, 14)
    ma20 = _full_avg(_window_vals("closes", 20, off), 20)
    sd20 = _full_std(_window_vals("closes", 20, off), 20)
    if off == 0:
        o, h, low, v = F.col("_o"), F.col("_h"), F.col("_l"), _el("volumes", 1, 0)
    else:
        o, h, low, v = _el("opens", 1, off), _el("highs", 1, off), _el("lows", 1, off), _el("volumes", 1, off)
    feats = {
        "open": o, "high": h, "low": low, "volume": v,
        "ma_20": ma20,
        "ma_50": _full_avg(_window_vals("closes", 50, off), 50),
        "rsi": F.lit(100.0) * F.try_divide(g, g + lo),
        "price_change": F.try_divide(c1, c2) - F.lit(1.0),
        "log_return": _ln(c1) - _ln(c2),
        "vol_5": _full_std(lr_vals(5), 5),
        "vol_20": _full_std(lr_vals(20), 20),
        "mom_5": F.try_divide(c1, _el("closes", 6, off)) - F.lit(1.0),
        "z_20": (c1 - ma20) / (sd20 + F.lit(1e-9)),
        "volume_ma": _full_avg(_window_vals("volumes", 10, off), 10),
    }
    for k in LAGS:
        feats[f"close_lag_{k}"] = _el("closes", k + 1, off)
        feats[f"ret_lag_{k}"] = F.try_divide(_el("closes", k + 1, off), _el("closes", k + 2, off)) - F.lit(1.0)
    return [feats[f].alias(f) for f in FEATURES]


def complete_bar() -> Column:
    """Whether a bar has its date and all five values."""
    ok = F.col("dt").isNotNull()
    for c in OHLCV:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok


def forecast_status(bars: DataFrame, model: Fitted | None = None, inference_row: str = "latest") -> DataFrame:
    """One row per symbol: bars, complete_bars and whether it can be forecast
    (``ok``, ``insufficient history``, or ``no model`` where a per-symbol model
    has no coefficients)."""
    need = STATE_CLOSES + (0 if inference_row == "latest" else 2)
    held = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count(F.when(complete_bar(), 1)).alias("complete_bars"))
    fitted = F.lit(True)
    own = None if model is None else model.coefs if model.coefs is not None else model.trees
    if own is not None:
        held = held.join(own.select("symbol", F.lit(True).alias("_fit")), "symbol", "left")
        fitted = F.col("_fit").isNotNull()
    status = F.when(F.col("complete_bars") < need, "insufficient history").when(~fitted, "no model").otherwise("ok")
    return held.select("symbol", "bars", "complete_bars", status.alias("status"))


def initial_state(bars: DataFrame, size: int = STATE_CLOSES) -> DataFrame:
    """One row per symbol: the last ``size`` closes and 12 volumes of its
    complete bars in date order, plus the last open/high/low and date.

    Bars with a missing value are left out, as the reference forecasts from
    rows without gaps.  ``row_number() <= size`` lets Spark keep that many rows
    per symbol and map task before the shuffle (WindowGroupLimit); a symbol
    with fewer complete bars has no state (see :func:`forecast_status`).
    """
    w = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    tail = bars.where(complete_bar()).select(
        "symbol", "dt", "open", "high", "low", "close", "volume", F.row_number().over(w).alias("_rn")
    ).where(F.col("_rn") <= size)
    g = tail.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.collect_list(F.struct("dt", "close", "volume", "open", "high", "low"))).alias("_rows"),
    ).where(F.col("_n") == size)
    return g.select(
        "symbol",
        F.element_at("_rows", -1)["dt"].alias("last_dt"),
        F.transform("_rows", lambda r: r["close"]).alias("closes"),
        F.slice(F.transform("_rows", lambda r: r["volume"]), -STATE_VOLUMES, STATE_VOLUMES).alias("volumes"),
        F.transform("_rows", lambda r: r["open"]).alias("opens"),
        F.transform("_rows", lambda r: r["high"]).alias("highs"),
        F.transform("_rows", lambda r: r["low"]).alias("lows"),
        F.element_at("_rows", -1)["open"].alias("_o"),
        F.element_at("_rows", -1)["high"].alias("_h"),
        F.element_at("_rows", -1)["low"].alias("_l"),
    )


def _numpy_features(closes: np.ndarray, volumes: np.ndarray, bar: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The 22 features of the newest bar of each state row (rows x time arrays)."""
    c = closes[:, ::-1]  # newest first
    with np.errstate(all="ignore"):
        logs = np.log(np.where(c > 0, c, np.nan))
        returns = logs[:, :20] - logs[:, 1:21]
        ratio = c[:, :-1] / np.where(c[:, 1:] != 0, c[:, 1:], np.nan) - 1.0
        delta = c[:, :14] - c[:, 1:15]
        gain, loss = np.where(delta > 0, delta, 0.0).mean(axis=1), np.where(delta < 0, -delta, 0.0).mean(axis=1)
        ma20 = c[:, :20].mean(axis=1)
        found = {
            "open": bar[0], "high": bar[1], "low": bar[2], "volume": volumes[:, -1],
            "ma_20": ma20, "ma_50": c[:, :50].mean(axis=1),
            "rsi": 100.0 * gain / np.where(gain + loss != 0, gain + loss, np.nan),
            "price_change": ratio[:, 0], "log_return": returns[:, 0],
            "vol_5": returns[:, :5].std(axis=1, ddof=1), "vol_20": returns.std(axis=1, ddof=1),
            "mom_5": c[:, 0] / np.where(c[:, 5] != 0, c[:, 5], np.nan) - 1.0,
            "z_20": (c[:, 0] - ma20) / (c[:, :20].std(axis=1, ddof=1) + 1e-9),
            "volume_ma": volumes[:, -10:].mean(axis=1),
        }
    for k in LAGS:
        found[f"close_lag_{k}"], found[f"ret_lag_{k}"] = c[:, k], ratio[:, k]
    return np.column_stack([found[f] for f in FEATURES])


def _linear_scores(frame: pd.DataFrame, use: list[int]):
    """Predictions of each state row's own linear model from its features."""
    mu, sd, w = (np.stack(frame[k].to_list()).astype(float) for k in ("mu", "sd", "w"))
    ybar = frame["ybar"].to_numpy(dtype=float)
    return lambda x: ybar + (w * (x[:, use] - mu) / sd).sum(axis=1)


def _tree_scores(frame: pd.DataFrame, use: list[int]):
    """Predictions of each state row's own trees, all trees of a row at once."""
    models = [trees.Flat(r) for r in frame.to_dict("records")]
    return lambda x: np.array([m.predict(x[i:i + 1, use])[0] for i, m in enumerate(models)])


def _walked(frame: pd.DataFrame, days: int, off: int, returns: bool, score) -> pd.DataFrame:
    """All steps of a batch of state rows."""
    held = {k: np.stack(frame[k].to_list()).astype(float) for k in ("closes", "volumes", "opens", "highs", "lows")}
    preds, prices = [], []
    for _ in range(days):
        end = -off or None
        bar = tuple(held[k][:, -1 - off] for k in ("opens", "highs", "lows"))
        y = score(_numpy_features(held["closes"][:, :end], held["volumes"][:, :end], bar))
        new = held["closes"][:, -1] * (1.0 + y / 100.0) if returns else y
        preds.append(y)
        prices.append(new)
        for k, v in (("closes", new), ("volumes", held["volumes"][:, -1]), ("opens", new), ("highs", new * HIGH_FACTOR), ("lows", new * LOW_FACTOR)):
            held[k] = np.column_stack([held[k][:, 1:], v])
    out = frame[["symbol", "last_dt"]].copy()
    out["preds"] = [[None if np.isnan(v) else float(v) for v in row] for row in np.column_stack(preds)]
    out["prices"] = [[None if np.isnan(v) else float(v) for v in row] for row in np.column_stack(prices)]
    return out


def _linear_paths(days: int, off: int, use: list[int], returns: bool):
    """All steps of a linear model for batches of state rows."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield _walked(frame, days, off, returns, _linear_scores(frame, use))

    return run


def _attach_linear(state: DataFrame, model: Fitted) -> DataFrame:
    return state.join(model.coefs.select("symbol", "mu", "sd", "ybar", "w"), "symbol", "inner")


def iterative_forecast(bars: DataFrame, model: Fitted, days: int = 7, target_type: str = "return",
                       inference_row: str = "latest", checkpoint_every: int = 3) -> DataFrame:
    """P2 + P3: ``days`` (1-30) steps ahead for every symbol at once; a symbol
    that cannot be forecast has its rows with NULL values and its status.

    Each step predicts from the features of the newest bar
    (``inference_row="latest"``; ``"reference"`` uses the bar two rows
    earlier, as the reference does), appends a bar with open = close,
    high/low = close x 1.01/0.99 and the volume carried, and moves the date
    to the next business day.  Returns (symbol, step, dt, y_hat, price, status).
    """
    if not 1 <= days <= 30:
        raise ValueError("days must be between 1 and 30")
    off = 0 if inference_row == "latest" else 2
    size = STATE_CLOSES + off
    state = initial_state(bars, size)
    linear_model = model.coefs is not None
    if linear_model:
        state = _attach_linear(state, model)
        use = [FEATURES.index(f) for f in model.features]
        paths = state.mapInPandas(_linear_paths(days, off, use, target_type == "return"),
                                  f"symbol string, last_dt {dict(state.dtypes)['last_dt']}, preds array<double>, prices array<double>")
        return _steps(paths, bars, model, days, inference_row)
    if model.trees is not None:
        use = [FEATURES.index(f) for f in model.features]
        returns = target_type == "return"
        # a symbol's state is one row, and so is its model: a group is those two
        paths = state.join(model.trees, "symbol").groupBy("symbol").applyInPandas(
            lambda frame: _walked(frame, days, off, returns, _tree_scores(frame, use)),
            f"symbol string, last_dt {dict(state.dtypes)['last_dt']}, preds array<double>, prices array<double>")
        return _steps(paths, bars, model, days, inference_row)
    state = state.withColumn("preds", F.array().cast("array<double>")).withColumn(
        "prices", F.array().cast("array<double>"))
    keep = state.columns
    ensure_checkpoint_dir(bars.sparkSession)
    # Column objects depend on column names only: build them once, reuse each step.
    feat_cols = state_features(off)
    last = F.element_at("closes", -1)
    new_close = price_from_return(last, F.col("_yhat")) if target_type == "return" else F.col("_yhat")
    carried = [c for c in keep if c not in ("closes", "volumes", "opens", "highs", "lows", "_o", "_h", "_l",
                                           "preds", "prices")]
    next_cols = [
        *carried,
        F.slice(F.concat("closes", F.array("_new")), 2, size).alias("closes"),
        F.slice(F.concat("volumes", F.array(F.element_at("volumes", -1))), 2, STATE_VOLUMES).alias("volumes"),
        F.slice(F.concat("opens", F.array("_new")), 2, size).alias("opens"),
        F.slice(F.concat("highs", F.array(F.col("_new") * HIGH_FACTOR)), 2, size).alias("highs"),
        F.slice(F.concat("lows", F.array(F.col("_new") * LOW_FACTOR)), 2, size).alias("lows"),
        F.col("_new").alias("_o"),
        (F.col("_new") * F.lit(HIGH_FACTOR)).alias("_h"),
        (F.col("_new") * F.lit(LOW_FACTOR)).alias("_l"),
        F.concat("preds", F.array("_yhat")).alias("preds"),
        F.concat("prices", F.array("_new")).alias("prices"),
    ]
    for step in range(1, days + 1):
        x = state.select("*", *feat_cols)
        scored = model.predict(x, "_yhat")
        state = scored.withColumn("_new", new_close).select(*next_cols).select(*keep)
        if step % checkpoint_every == 0 and step < days:
            state = state.checkpoint(eager=True)
    return _steps(state, bars, model, days, inference_row)


def _steps(state: DataFrame, bars: DataFrame, model: Fitted, days: int, inference_row: str) -> DataFrame:
    """One row per symbol and step from the accumulated arrays, with the status."""
    out = state.select("symbol", "last_dt", F.posexplode(F.arrays_zip("preds", "prices")).alias("_p", "_v"))
    step_col = (F.col("_p") + 1).cast("int")
    steps = out.select("symbol", step_col.alias("step"), business_days_after(F.col("last_dt"), step_col).alias("dt"),
                       F.col("_v")["preds"].alias("y_hat"), F.col("_v")["prices"].alias("price"))
    asked = forecast_status(bars, model, inference_row).select(
        "symbol", "status", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("step"))
    return asked.join(steps, ["symbol", "step"], "left").select("symbol", "step", "dt", "y_hat", "price", "status")


def one_step(ind_live: DataFrame, sup: DataFrame, model: Fitted, target_type: str = "return",
             inference_row: str = "latest", processed: DataFrame | None = None) -> DataFrame:
    """P1 + P5: next-step prediction per symbol, price, change and signal.

    ``latest`` scores the newest bar of the processed table kept with
    ``drop_incomplete=False`` and starts from its close; ``reference`` scores
    the last supervised row and starts from the last close of the processed
    table (``processed``), one bar before the newest, as the reference does.
    """
    if inference_row != "latest" and processed is None:
        raise ValueError("inference_row='reference' needs the processed table")
    w = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    src = ind_live if inference_row == "latest" else sup
    row = src.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    current = (ind_live if inference_row == "latest" else processed).groupBy("symbol").agg(F.max_by("close", "dt").alias("current_price"))
    scored = model.predict(row.select("symbol", "dt", *FEATURES)).join(current, "symbol")
    y = F.col("prediction")
    nxt = price_from_return(F.col("current_price"), y) if target_type == "return" else y
    return scored.select(
        "symbol", "dt", "current_price", y.alias("y_hat"), nxt.alias("next_price"),
        (nxt - F.col("current_price")).alias("delta"),
        change_pct(nxt, F.col("current_price")).alias("pct"),
    ).withColumn("signal", signal(F.col("pct")))


def price_path(preds: DataFrame, base: DataFrame, ret_col: str = "y_hat", order: str = "step",
               segment_rows: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Compound percent returns onto a base price per symbol.

    ``price_k = base * prod_{j<=k} (1 + r_j/100)`` as ``exp`` of a running
    sum of logs (requires r > -100, else NULL).  The logs are summed as
    DECIMAL(38,12): decimal addition is exact, so the path does not depend
    on the order in which an engine or a partitioning adds the terms.

    With ``segment_rows`` the sums are a prefix scan: each symbol is cut into
    segments of that many rows, the segments' totals are summed over the small
    table of segments, and a running sum inside each segment starts from there;
    no task holds a whole symbol.  ``bucket`` is a coarse column that rises with
    ``order`` (see ``segments.with_positions``; by default the time bucket, or
    blocks of steps for a numeric order).
    """
    w = Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = F.when(F.col(ret_col) > -100, F.ln(F.lit(1.0) + F.col(ret_col) / F.lit(100.0))).cast("decimal(38,12)")
    p = preds.join(base.select("symbol", "base_price"), "symbol")
    broken = F.when(g.isNull(), 1).otherwise(0)
    bad, logsum = F.sum(broken).over(w), F.sum(g).over(w).cast("double")
    if segment_rows is not None:
        if bucket is None and isinstance(p.schema[order].dataType, T.NumericType):
            bucket = F.floor(F.col(order) / F.lit(segment_rows))
        p = with_positions(p, order=order, bucket=bucket).withColumn("_seg", F.floor(F.col("_pos") / F.lit(segment_rows)))
        p = p.withColumns({"_g": F.coalesce(g, F.lit(0).cast("decimal(38,12)")), "_bad": broken})
        exact = "decimal(36,12)"  # so that a sum of two keeps all twelve digits
        before = Window.partitionBy("symbol").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        totals = p.groupBy("symbol", "_seg").agg(F.sum("_g").alias("_sum"), F.sum("_bad").alias("_bads"))
        totals = totals.select("symbol", "_seg", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast(exact).alias("_sum0"),
                               F.coalesce(F.sum("_bads").over(before), F.lit(0)).alias("_bad0"))
        inside = Window.partitionBy("symbol", "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        p = p.join(totals, ["symbol", "_seg"])
        bad, logsum = F.col("_bad0") + F.sum("_bad").over(inside), (F.col("_sum0") + F.sum("_g").over(inside).cast(exact)).cast("double")
        path = F.when(bad == 0, F.col("base_price") * F.exp(logsum))
        return p.withColumn("path_price", path).drop("_seg", "_pos", "_n", "_g", "_bad", "_sum0", "_bad0")
    return p.withColumn("path_price", F.when(bad == 0, F.col("base_price") * F.exp(logsum)))
