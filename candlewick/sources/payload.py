"""Nested JSON payloads of provider B (S2) and their status (S3).

A payload row is ``(symbol, payload)`` with
``{"Time Series (Daily)": {"yyyy-MM-dd": {"1. open": "..", ..., "5. volume": ".."}}}``.
Parsing is ``from_json`` to a map and one ``explode``: the work per row is
the size of its document, and a provider that lands a symbol's history in
several documents (one per year, say) is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.schema import BAR_COLUMNS
from candlewick.sources.wide import to_date, to_double

# Provider B keys.
SERIES_KEY = "Time Series (Daily)"
FIELD_KEYS = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "5. volume"}
STATUS_KEYS = {"note": "Note", "info": "Information", "error": "Error Message"}

_SCHEMA = f"struct<`{SERIES_KEY}`: map<string, map<string, string>>, `Error Message`: string>"


def parse_payload(df: DataFrame, strict: bool = False, source: str = "provider_b") -> DataFrame:
    """Payload rows -> bars.  A bad number becomes NULL (its row is
    dropped later by N4); ``strict=True`` drops every row of a payload that
    has a bad number or an ``Error Message`` (the reference's behaviour)."""
    p = df.select("symbol", F.from_json(F.col("payload"), _SCHEMA).alias("_j"))
    if strict:  # tested on the document's map before it is exploded: one narrow pass
        def good(fields: Column) -> Column:
            ok = F.lit(True)
            for k in FIELD_KEYS.values():
                ok = ok & to_double(fields[k]).isNotNull()
            return ok

        p = p.where(F.col("_j")["Error Message"].isNull() & F.forall(F.map_values(F.col("_j")[SERIES_KEY]), good))
    e = p.select("symbol", F.explode(F.col("_j")[SERIES_KEY]).alias("_d", "_f"))
    bars = e.select("symbol", to_date(F.col("_d")).alias("dt"), *[
        to_double(F.col("_f")[k]).alias(c) for c, k in FIELD_KEYS.items()])
    return bars.withColumn("source", F.lit(source)).select(*BAR_COLUMNS)


def payload_status(df: DataFrame) -> DataFrame:
    """S3: per payload row: ok, rate limited, error, unknown or connection failed.

    The first match wins in this order; a reply that is not a JSON object
    counts as a failed connection.
    """
    keys = F.json_object_keys(F.col("payload"))
    has = lambda k: F.array_contains(keys, F.lit(k))
    msg: Column = F.get_json_object(F.col("payload"), f"$['{STATUS_KEYS['error']}']")
    status = (F.when(keys.isNull(), F.lit("connection failed"))
              .when(has(SERIES_KEY), F.lit("ok"))
              .when(has(STATUS_KEYS["note"]) | has(STATUS_KEYS["info"]), F.lit("rate limited"))
              .when(has(STATUS_KEYS["error"]), F.lit("error"))
              .otherwise(F.lit("unknown")))
    return df.select("symbol", status.alias("status"),
                     F.when(status == "error", msg).alias("message"))


def payloads_from_bars(bars: DataFrame) -> DataFrame:
    """Stand-in landing data: provider B documents, one per (symbol, year).

    Builds the provider's JSON text from bars (numbers as text); it does no
    parsing work of its own.
    """
    fields = F.create_map(*[x for c, k in FIELD_KEYS.items() for x in (F.lit(k), F.col(c).cast("string"))])
    g = bars.groupBy("symbol", F.year("dt").alias("_y")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.date_format("dt", "yyyy-MM-dd"), fields))).alias("_ts"))
    return g.select("symbol", F.to_json(F.struct(F.col("_ts").alias(SERIES_KEY))).alias("payload"))
