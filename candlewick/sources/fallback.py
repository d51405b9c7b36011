"""Per-symbol source status and fallback across tiers.

Tiers are a short ordered list of bar tables (provider A, provider B, any
last-resort table).  The choice is per symbol: row counts per (symbol,
tier) by one aggregation, the first tier with rows wins, and the bars of
that tier are kept by a semi-join on (symbol, tier) -- no symbol's rows
move through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tagged(tiers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for prio, (name, bars) in enumerate(tiers):
        t = bars.withColumn("_tier", F.lit(prio)).withColumn("source", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


def source_status(requested: DataFrame, tiers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(symbol, source, rows, status) for every requested symbol and tier."""
    counts = _tagged(tiers).groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("rows"))
    names = F.array(*[F.lit(n) for n, _ in tiers])
    grid = requested.select("symbol").distinct().withColumn("source", F.explode(names))
    j = grid.join(counts, ["symbol", "source"], "left")
    rows = F.coalesce(F.col("rows"), F.lit(0)).cast("long")
    return j.select("symbol", "source", rows.alias("rows"),
                    F.when(rows > 0, F.lit("has rows")).otherwise(F.lit("no data")).alias("status"))


def with_fallback(requested: DataFrame, tiers: Sequence[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Bars of the first tier that has rows for each symbol, plus a trace
    (symbol, attempt, source, ok) of the attempts made up to that tier."""
    tagged = _tagged(tiers)
    req = requested.select("symbol").distinct()
    have = tagged.groupBy("symbol", "_tier").agg(F.count(F.lit(1)).alias("_n"))
    chosen = have.join(req, "symbol", "left_semi").groupBy("symbol").agg(F.min("_tier").alias("_tier"))
    bars = tagged.join(chosen, ["symbol", "_tier"], "left_semi").drop("_tier")
    names = F.array(*[F.struct(F.lit(i).alias("_tier"), F.lit(n).alias("source")) for i, (n, _) in enumerate(tiers)])
    grid = req.select("symbol", F.explode(names).alias("_t")).select("symbol", "_t._tier", "_t.source")
    pick = chosen.withColumnRenamed("_tier", "_best")
    trace = grid.join(pick, "symbol", "left").where(F.col("_best").isNull() | (F.col("_tier") <= F.col("_best")))
    trace = trace.select("symbol", (F.col("_tier") + 1).alias("attempt"), "source",
                         (F.col("_tier") == F.col("_best")).alias("ok"))
    return bars, trace.na.fill({"ok": False})
