"""CSV export (S8): the whole table, one folder per symbol, with header."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_name(symbol: Column, as_of: Column) -> Column:
    """The name of a symbol's export of a day."""
    return F.concat(symbol, F.lit("_stock_data_"), F.date_format(as_of, "yyyyMMdd"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", as_of: dt.date | None = None) -> str:
    """Write ``df`` as CSV partitioned by symbol (each task writes its own
    files; nothing passes through the driver).

    With ``as_of`` a symbol's folder is named ``export=<name>`` by
    :func:`export_name`, and the symbol is a column of the files; exports of
    several days lie side by side under one path, and a day that is written
    again replaces its own folders only."""
    if as_of is None:
        df.write.mode(mode).partitionBy("symbol").option("header", True).csv(path)
        return path
    named = df.withColumn("export", export_name(F.col("symbol"), F.lit(as_of)))
    writer = named.write.mode(mode).partitionBy("export").option("header", True)
    (writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer).csv(path)
    return path
