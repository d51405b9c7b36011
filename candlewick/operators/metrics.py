"""Regression metrics grouped by any keys.

One aggregation pass: sums of e^2, |e|, y and y^2 per group give RMSE, MAE
and R^2 (SST from the sums, which is exact enough for scores and keeps
the pass a plain partial aggregation).  R^2 follows scikit-learn: NULL
below two rows; with SST = 0 it is 1.0 for a perfect fit, else 0.0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, keys: Sequence[str], y: str = "label", yhat: str = "prediction") -> DataFrame:
    """A10: n, rmse, mae, r2 per group of ``keys``."""
    e = F.col(y) - F.col(yhat)
    g = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("_sse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.col(y)).alias("_ybar"),
        F.var_pop(F.col(y)).alias("_yvar"),
    )
    sst = F.col("_yvar") * F.col("n")
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
          .when(sst == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.try_divide(F.col("_sse"), sst)))
    return g.select(*keys, F.col("n").cast("long").alias("n"),
                    F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), "mae", r2.alias("r2"))


def fold_means(fold_metrics: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean of fold RMSE/MAE/R^2 (undefined R^2 is left out of its mean)."""
    return fold_metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("folds"),
        F.avg("rmse").alias("cv_rmse"), F.avg("mae").alias("cv_mae"), F.avg("r2").alias("cv_r2"))


def metric_record(cv: DataFrame | None, test: DataFrame, keys: Sequence[str] = ("symbol",),
                  train_sizes: DataFrame | None = None, features: Sequence[str] = ()) -> DataFrame:
    """CV means (``cv_*``, NULL without CV) beside hold-out metrics, the
    sizes of both parts (``train_sizes``: keys, train_size) and the features."""
    t = test.select(*keys, F.col("rmse").alias("test_rmse"), F.col("mae").alias("test_mae"),
                    F.col("r2").alias("test_r2"), F.col("n").alias("test_size"))
    if train_sizes is not None:
        t = t.join(train_sizes.select(*keys, "train_size"), list(keys), "left")
    if features:
        t = t.withColumn("features", F.lit(", ".join(features)))
    if cv is None:
        return t.select("*", *[F.lit(None).cast("double").alias(c) for c in ("cv_rmse", "cv_mae", "cv_r2")])
    return t.join(cv.select(*keys, "cv_rmse", "cv_mae", "cv_r2"), list(keys), "left")
