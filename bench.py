"""

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every job is forced end to end with the no-op sink (nothing collected).
Bars are resampled once and kept with ``persist`` (as a job would land
them); every later job starts from them.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import StorageLevel  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from candlewick.operators import explain as X  # noqa: E402
from candlewick.operators import forecast as fc  # noqa: E402
from candlewick.operators import models as M  # noqa: E402
from candlewick.operators import stats  # noqa: E402
from candlewick.operators import supervised as sv  # noqa: E402
from candlewick.operators.windows import indicator_table  # noqa: E402
from candlewick.session import local_session  # noqa: E402
from candlewick.sources.trades import lineitem_bars  # noqa: E402

MEM = StorageLevel.MEMORY_AND_DISK


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def shuffled(log_dir: str, spans: dict[str, tuple[float, float]]) -> dict[str, float]:
    """MB of shuffle written during each job, from Spark's event log (uncompressed)."""
    out, tasks = dict.fromkeys(spans, 0.0), 0
    for folder, _, files in os.walk(log_dir):
        for name in files:
            for line in open(os.path.join(folder, name), errors="replace"):
                if '"SparkListenerTaskEnd"' not in line:
                    continue
                e = json.loads(line)
                tasks += 1
                at = e["Task Info"]["Launch Time"] / 1000
                mb = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0) / 1e6
                for k, (a, b) in spans.items():
                    if a <= at <= b:
                        out[k] += mb
    if not tasks:
        raise RuntimeError(f"no task in the event log at {log_dir}")
    return {k: round(v, 1) for k, v in out.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    log_dir = tempfile.mkdtemp(prefix="candlewick-bench-events-")
    os.environ["PYSPARK_SUBMIT_ARGS"] = f"--conf spark.eventLog.enabled=true --conf spark.eventLog.compress=false --conf spark.eventLog.rolling.enabled=false --conf spark.eventLog.dir=file://{log_dir} pyspark-shell"
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="candlewick-bench")
    spans: dict[str, tuple[float, float]] = {}
    times: dict[str, float] = {}
    info: dict[str, int] = {}

    def timed(name, fn):
        t = time.time()
        out = fn()
        spans[name] = (t, time.time())
        times[name] = round(time.time() - t, 3)
        return out

    # 1. trades -> bars -> full indicator table (6 symbols)
    bars = lineitem_bars(spark, sf_dir).persist(MEM)
    info["bars"] = timed("bars_from_trades", lambda: bars.count())
    timed("indicator_table", lambda: sink(indicator_table(bars)))
    timed("indicator_table_segmented", lambda: sink(indicator_table(bars, segment_rows=1000)))
    timed("diagnostics", lambda: sink(stats.diagnostics(indicator_table(bars))))

    # 2. about 1,000 symbols and 2.5 million bars: the bars of each symbol, scaled, under many names
    copies = 1000 // max(1, bars.select("symbol").distinct().count())
    many = bars.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    many = many.select(F.concat_ws("-", "symbol", "_c").alias("symbol"), "dt",
                       *[(F.col(c) * (1 + F.col("_c") / 1000)).alias(c) for c in ("open", "high", "low", "close")],
                       (F.col("volume") + F.pmod(F.col("_c") * 7 + F.dayofyear("dt"), F.lit(13))).alias("volume"), "source").persist(MEM)
    info["many_bars"] = timed("many_bars", lambda: many.count())
    many_ind = indicator_table(many).persist(MEM)
    info["many_processed_rows"] = timed("many_indicator_table", lambda: many_ind.count())
    many_sup = sv.supervised(many_ind).persist(MEM)
    info["many_symbols"] = many_sup.select("symbol").distinct().count()
    timed("many_cv_ridge_per_symbol", lambda: sink(M.cv_score("ridge", many_sup)[0]))
    many_ridge = M.fit("ridge", many_sup)
    many_ridge.coefs = many_ridge.coefs.persist(MEM)
    timed("many_fit_ridge", lambda: many_ridge.coefs.count())
    timed("many_forecast_30", lambda: sink(fc.iterative_forecast(many, many_ridge, 30)))
    times["many_forecast_per_step"] = round(times["many_forecast_30"] / 30, 3)

    # 3. models and explanations on the 6 symbols
    sup = sv.supervised(indicator_table(bars)).persist(MEM)
    info["supervised_rows"] = timed("supervised", lambda: sup.count())
    timed("cv_ridge_per_symbol", lambda: sink(M.cv_score("ridge", sup)[0]))
    timed("cv_lasso_per_symbol", lambda: sink(M.cv_score("lasso", sup)[0]))
    timed("random_search_ridge", lambda: sink(M.random_search("ridge", sup, 5, 20)[1]))
    timed("cv_forest_5_folds", lambda: sink(M.cv_score("random_forest", sup, scope="symbol")[0]))
    times["forest_per_fold"] = round(times["cv_forest_5_folds"] / 5, 3)
    timed("cv_gbt_5_folds", lambda: sink(M.cv_score("gbt", sup, scope="symbol")[0]))
    ridge = M.fit("ridge", sup)
    ridge.coefs = ridge.coefs.persist(MEM)
    timed("forecast_30_ridge", lambda: sink(fc.iterative_forecast(bars, ridge, 30)))
    timed("importance_ridge_22x10", lambda: sink(X.permutation_importance(ridge, sup)))
    forest = M.fit("random_forest", sup)
    timed("importance_forest_22x10", lambda: sink(X.permutation_importance(forest, sup)))
    timed("backtest_gbt_200_rounds", lambda: sink(M.backtest("gbt", sup, scope="symbol")[0]))
    timed("shapley_forest", lambda: sink(X.sampled_shapley(forest, sup, orders=8)))
    own_forest = M.fit("random_forest", sup, scope="symbol")
    own_forest.trees = own_forest.trees.persist(MEM)
    timed("forecast_30_forest", lambda: sink(fc.iterative_forecast(bars, own_forest, 30)))
    timed("contributions_forest", lambda: sink(X.exact_tree_contributions(own_forest, sup)))

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    total = round(sum(v for k, v in times.items() if not k.endswith("per_step") and not k.endswith("per_fold")), 3)
    spark.stop()  # flushes the event log
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "shuffle_mb": shuffled(log_dir, spans), "rows": info, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
