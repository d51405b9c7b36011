"""The reference's whole run (E1 + E2 + E3) as one call over many symbols.

``analyse`` returns named DataFrames (all lazy).  The indicator and
supervised tables are persisted because CV, back-test, forecast and
explanations all read them.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.grades import r2_grade
from candlewick.functions.money import display_currency
from candlewick.operators import explain as X
from candlewick.operators import forecast as fc
from candlewick.operators import lookups
from candlewick.operators import metrics as met
from candlewick.operators import models as M
from candlewick.operators import stats
from candlewick.operators import supervised as sv
from candlewick.operators.windows import indicator_table


def analyse(bars: DataFrame, model: str = "random_forest", target_type: str = "return", cv: int | None = 5,
            days: int = 7, refit: bool = False, inference_row: str = "latest", explain: bool = True,
            params: dict | None = None, segment_rows: int | None = None) -> dict[str, DataFrame]:
    """Features, diagnostics, CV (``cv=None`` skips it, D30), 80/20 back-test,
    one-step and ``days``-step forecasts and explanations for every symbol.

    ``refit=False`` forecasts with the back-test model fitted on the first
    80 % (the reference, D13); ``True`` refits on all rows first.
    ``segment_rows`` runs the ordered windows over bounded segments (long
    intraday series of a hot symbol); results are the same.
    """
    mem = StorageLevel.MEMORY_AND_DISK
    ind = indicator_table(bars, segment_rows=segment_rows).persist(mem)
    live = indicator_table(bars, drop_incomplete=False, segment_rows=segment_rows)
    sup = sv.supervised(ind, 1, target_type, segment_rows=segment_rows).persist(mem)
    out: dict[str, DataFrame] = {
        "indicators": ind,
        "diagnostics": stats.diagnostics(ind, segment_rows=segment_rows),
        "volatility": stats.volatility(ind, segment_rows=segment_rows),
        "key_stats": stats.key_stats(ind),
        "history_status": stats.history_status(bars, ind, cv or 5),
    }
    means = None
    if cv:
        fm, means = M.cv_score(model, sup, cv, params=params)
        out["cv_folds"], out["cv_means"] = fm, means
    bt, bt_metrics, fitted = M.backtest(model, sup, params=params)
    out["backtest"] = bt
    sizes = sv.holdout(sup).where(F.col("role") == "train").groupBy("symbol").agg(F.count(F.lit(1)).alias("train_size"))
    rec = met.metric_record(means, bt_metrics, train_sizes=sizes, features=fitted.features)
    out["metrics"] = rec.withColumn("grade", r2_grade(F.col("test_r2")))
    if refit:
        fitted = M.fit(model, sup, params=params)
    out["one_step"] = fc.one_step(live, sup, fitted, target_type, inference_row, processed=ind)
    out["forecast"] = fc.iterative_forecast(bars, fitted, days, target_type, inference_row)
    if explain:
        out["importance"] = X.rank_importance(X.permutation_importance(fitted, sup))
        contrib = (X.linear_contributions(fitted, sup) if fitted.coefs is not None
                   else X.sampled_shapley(fitted, sup))
        out["contributions"] = contrib
        info = lookups.instrument_info(ind.sparkSession, ind.select("symbol").distinct(), "symbol")
        money = info.select("symbol", display_currency(F.col("currency")).alias("_money"))
        text = X.narrative(contrib.join(money, "symbol"), target_type, F.col("_money"))
        out["narrative"] = text.join(X.net_effect(contrib), "symbol")
    return out
