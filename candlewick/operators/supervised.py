"""Supervised set, walk-forward folds and hold-out split (V1-V3).

Positions are ``row_number()`` over ``(symbol, dt)``; fold bounds need the
row count of the symbol, taken from the same window.  Rows x folds is an
``explode`` of a fixed-length sequence -- a narrow operation, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators.windows import pct_change, series_window
from candlewick.schema import FEATURES, present


def supervised(ind: DataFrame, horizon: int = 1, target_type: str = "return",
               segment_rows: int | None = None) -> DataFrame:
    """V1: symbol, dt, position ``i``, row count ``n``, the 22 features and ``label``.

    ``return``: the one-row percent change found ``horizon`` rows ahead
    (x100); ``price``: the close ``horizon`` rows ahead.  The last
    ``horizon`` rows per symbol have no label and are dropped.  Rows are
    those of the processed table ``ind``.
    """
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    if segment_rows:
        return _supervised_segmented(ind, horizon, target_type, segment_rows)
    w = series_window()
    feats = present(ind, FEATURES)
    if target_type == "return":
        r = pct_change(F.col("close"), F.lag("close", 1).over(w))
        staged = ind.withColumn("_r", r)
        label = F.lead("_r", horizon).over(w) * F.lit(100.0)
    elif target_type == "price":
        staged = ind
        label = F.lead("close", horizon).over(w)
    else:
        raise ValueError("target_type must be 'return' or 'price'")
    out = staged.select(
        "symbol", "dt", "close", *feats,
        (F.row_number().over(w) - 1).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("_n_all"),
        label.alias("label"),
    )
    out = out.where(F.col("i") < F.col("_n_all") - horizon)
    return out.select("symbol", "dt", "i", (F.col("_n_all") - horizon).cast("int").alias("n"),
                      "close", *feats, "label")


def folds(sup: DataFrame, k: int = 5) -> DataFrame:
    """V2: walk-forward folds (expanding train, equal test blocks).

    With ``t = n div (k+1)``, fold ``f`` tests rows ``[n-(k-f+1)t, n-(k-f)t)``
    and trains on every row before them.  Adds ``fold`` and ``role``
    (``train``/``test``); rows after a fold's test block do not appear in
    that fold.  Symbols with fewer than ``k+1`` rows get no folds.
    """
    t = (F.col("n") / F.lit(k + 1)).cast("int")
    x = sup.where(F.col("n") >= k + 1).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    start = F.col("n") - (F.lit(k + 1) - F.col("fold")) * t
    end = start + t
    role = F.when(F.col("i") < start, F.lit("train")).when(F.col("i") < end, F.lit("test"))
    return x.withColumn("role", role).where(F.col("role").isNotNull())


def blocks(sup: DataFrame, k: int = 5) -> DataFrame:
    """The walk-forward folds without copies: column ``fold`` is 0 for the rows
    before the first test block and f for the rows of test block f, so fold f
    tests block f and trains on all blocks below it."""
    t = (F.col("n") / F.lit(k + 1)).cast("int")
    start = F.col("n") - F.lit(k) * t
    block = F.when(F.col("i") < start, F.lit(0)).otherwise(F.floor((F.col("i") - start) / t) + 1).cast("int")
    return sup.where(F.col("n") >= k + 1).withColumn("fold", block)


def holdout(sup: DataFrame, test_size: float = 0.2) -> DataFrame:
    """V3: first ``int(n*(1-test_size))`` rows train, the rest test."""
    split = F.floor(F.col("n") * F.lit(1.0 - test_size)).cast("int")
    return sup.withColumn("role", F.when(F.col("i") < split, F.lit("train")).otherwise(F.lit("test")))


def fold_sizes(sup: DataFrame, k: int = 5) -> DataFrame:
    """Row counts per (symbol, fold, role), for reports and checks."""
    return folds(sup, k).groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).cast("long").alias("rows"))


def _supervised_segmented(ind: DataFrame, horizon: int, target_type: str, segment_rows: int) -> DataFrame:
    """V1 with positions from bucket counts and windows over bounded segments
    (one row of look-back halo, ``horizon`` rows of look-ahead halo)."""
    from candlewick.operators import segments as seg

    feats = present(ind, FEATURES)
    s = seg.segment(seg.with_positions(ind), segment_rows, back=1, fwd=horizon)
    w = seg.segment_window()
    if target_type == "return":
        s = s.withColumn("_r", pct_change(F.col("close"), F.lag("close", 1).over(w)))
        label = F.lead("_r", horizon).over(w) * F.lit(100.0)
    elif target_type == "price":
        label = F.lead("close", horizon).over(w)
    else:
        raise ValueError("target_type must be 'return' or 'price'")
    out = s.withColumn("label", label).where(~F.col("_halo") & (F.col("_pos") < F.col("_n") - horizon))
    return out.select("symbol", "dt", F.col("_pos").cast("int").alias("i"),
                      (F.col("_n") - horizon).cast("int").alias("n"), "close", *feats, "label")
