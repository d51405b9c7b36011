"""OHLCV bars from trade rows (time-bucket resampling).

One ``groupBy(symbol, bucket)`` with partial aggregation: every map task
folds its trades into at most one row per (symbol, bucket) before the
shuffle, so a symbol holding a third of all trades ships no more rows than
any other.  Open/close are the first/last trade by an explicit, unique
order key (``min_by``/``max_by`` on a struct), never by arrival order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.schema import BAR_COLUMNS


def _bucket(ts: Column, bucket: str) -> Column:
    if bucket == "day":
        return ts.cast("date")
    if bucket in ("hour", "minute"):
        return F.date_trunc(bucket, ts).cast("timestamp_ntz")
    raise ValueError(f"unknown bucket {bucket!r}; use 'day', 'hour' or 'minute'")


def bars_from_trades(
    trades: DataFrame,
    symbol: Column,
    ts: Column,
    price: Column,
    size: Column,
    order_by: Sequence[Column],
    bucket: str = "day",
    source: str = "trades",
) -> DataFrame:
    """Resample trades into one bar per (symbol, bucket).

    ``order_by`` must be unique per trade; it decides open and close.
    Trades without symbol, time or price are left out.
    """
    t = trades.select(
        symbol.cast("string").alias("symbol"),
        _bucket(ts, bucket).alias("dt"),
        price.cast("double").alias("price"),
        size.cast("double").alias("size"),
        F.struct(*order_by).alias("ord"),
    ).where(F.col("symbol").isNotNull() & F.col("dt").isNotNull() & F.col("price").isNotNull())
    bars = t.groupBy("symbol", "dt").agg(
        F.min_by("price", "ord").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ord").alias("close"),
        F.sum("size").alias("volume"),
    )
    return bars.withColumn("source", F.lit(source)).select(*BAR_COLUMNS)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from ``lineitem`` read as trades (symbol = returnflag||linestatus)."""
    li = _read(spark, sf_dir, "lineitem")
    return bars_from_trades(
        li,
        symbol=F.concat(li.l_returnflag, li.l_linestatus),
        ts=li.l_shipdate,
        price=F.try_divide(li.l_extendedprice, li.l_quantity),
        size=li.l_quantity,
        order_by=[li.l_orderkey, li.l_linenumber, li.l_partkey, li.l_suppkey, li.l_extendedprice],
        bucket="day",
        source="lineitem",
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from ``events`` by event type (price = value, size = 1 per event)."""
    ev = _read(spark, sf_dir, "events")
    return bars_from_trades(
        ev,
        symbol=ev.event_type,
        ts=ev.ts,
        price=ev.value,
        size=F.lit(1.0),
        order_by=[ev.ts, ev.event_id],
        bucket="hour",
        source="events",
    )


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from ``orders`` by order status (price = total price, size = 1)."""
    o = _read(spark, sf_dir, "orders")
    return bars_from_trades(
        o,
        symbol=o.o_orderstatus,
        ts=o.o_orderdate,
        price=o.o_totalprice,
        size=F.lit(1.0),
        order_by=[o.o_orderkey],
        bucket="day",
        source="orders",
    )
