"""Bars of many symbols, some of them short or with gaps, from the trades.

Symbols are dealt by part key (about 50 trades each at the small scale); by
the same key some symbols lose the closes of every 13th of a month, some all
their volumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.plans.sqlkit import BARS
from candlewick.sources.trades import bars_from_trades

_RAW = BARS.replace("l_returnflag || l_linestatus AS symbol", "l_returnflag || l_linestatus || '-' || (l_partkey % 199) AS symbol")
GAPPY_SQL = f"""SELECT symbol, dt, open, high, low,
  CASE WHEN CAST(split_part(symbol, '-', 2) AS INTEGER) % 7 = 0 AND day(dt) = 13 THEN NULL ELSE close END AS close,
  CASE WHEN CAST(split_part(symbol, '-', 2) AS INTEGER) % 11 = 0 THEN NULL ELSE volume END AS volume, source FROM ({_RAW}) raw"""


def gappy_bars(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    symbol = F.concat(li.l_returnflag, li.l_linestatus, F.lit("-"), (li.l_partkey % 199).cast("string"))
    bars = bars_from_trades(li, symbol, li.l_shipdate, F.try_divide(li.l_extendedprice, li.l_quantity), li.l_quantity,
                            [li.l_orderkey, li.l_linenumber, li.l_partkey, li.l_suppkey, li.l_extendedprice])
    key = F.element_at(F.split("symbol", "-"), 2).cast("int")
    return (bars.withColumn("close", F.when(~((key % 7 == 0) & (F.dayofmonth("dt") == 13)), F.col("close")))
            .withColumn("volume", F.when(key % 11 != 0, F.col("volume"))))
