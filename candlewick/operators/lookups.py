"""Dimension look-ups.

The symbol and instrument dimensions have a fixed size, so they are
broadcast; the fact side is never shuffled for these joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.dims import (
    DEFAULT_CURRENCY, DEFAULT_INDUSTRY, DEFAULT_SECTOR, MARKETS, instrument_table, symbol_table,
)
from candlewick.functions.symbols import PROVIDER_A_DEFAULT_SUFFIX, base_symbol, provider_a_candidates


def symbol_lookup(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """(market, label) -> ticker.  A listed market maps through the
    table (an unlisted label gives NULL); any other market keeps the label."""
    dim = F.broadcast(symbol_table(spark).withColumnRenamed("ticker", "_t"))
    j = requests.join(dim, ["market", "label"], "left")
    known = F.col("market").isin(*MARKETS.keys())
    return j.select(*requests.columns, F.when(known, F.col("_t")).otherwise(F.col("label")).alias("ticker"))


def instrument_info(spark: SparkSession, tickers: DataFrame, col: str = "ticker") -> DataFrame:
    """Name, sector, industry, currency per ticker, with defaults.

    The key is the whole upper-cased ticker when it is listed (``BRK.B``),
    else the text before the first dot (``RELIANCE.NS`` -> ``RELIANCE``).
    """
    dim = instrument_table(spark)
    t = tickers.withColumn("_full", F.upper(F.col(col))).withColumn("_base", base_symbol(F.col(col)))
    full = F.broadcast(dim.select(F.col("key").alias("_full"), *[F.col(c).alias(f"_f_{c}") for c in
                                                                  ("name", "sector", "industry", "currency")]))
    base = F.broadcast(dim.select(F.col("key").alias("_base"), *[F.col(c).alias(f"_b_{c}") for c in
                                                                  ("name", "sector", "industry", "currency")]))
    j = t.join(full, "_full", "left").join(base, "_base", "left")
    defaults = {"name": F.col(col), "sector": F.lit(DEFAULT_SECTOR), "industry": F.lit(DEFAULT_INDUSTRY),
                "currency": F.lit(DEFAULT_CURRENCY)}
    return j.select(*tickers.columns, *[
        F.coalesce(F.col(f"_f_{c}"), F.col(f"_b_{c}"), d).alias(c) for c, d in defaults.items()
    ])


def resolve_provider_a(tickers: DataFrame, bars: DataFrame, col: str = "ticker", market: str | None = None) -> DataFrame:
    """First of ``BASE.NS``, ``BASE.BO``, ``BASE`` that has bars, else ``BASE.NS``.

    Candidates are matched against the distinct symbols of ``bars`` (an
    aggregation first, so the join side is one row per symbol).
    """
    have = bars.select(F.col("symbol").alias("candidate")).distinct()
    cand = tickers.select(col, F.explode(provider_a_candidates(F.col(col), market)).alias("c")).select(
        col, "c.rank", "c.candidate")
    hit = cand.join(have, "candidate", "left_semi")
    best = hit.groupBy(col).agg(F.min_by("candidate", "rank").alias("_hit"))
    out = tickers.join(best, col, "left")
    default = base_symbol(F.col(col)) if market == "US Stocks" else F.concat(
        base_symbol(F.col(col)), F.lit(PROVIDER_A_DEFAULT_SUFFIX))
    return out.select(*tickers.columns, F.coalesce(F.col("_hit"), default).alias("resolved"))
