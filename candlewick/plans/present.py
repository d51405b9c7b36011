"""Result presentation shared by the registered queries.

Doubles are rounded at the very end so Spark and the DuckDB oracle agree
to the last digit: raw prices to 8 decimals (a trade price quotient that
terminates has at most 7), derived values to 4.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that carry a raw price (rounded to 8 decimals).
PRICE_COLUMNS = {
    "open", "high", "low", "close", "volume", "fwd_price_1d", "last", "prev",
    "close_lag_1", "close_lag_2", "close_lag_3", "close_lag_5",
    "period_high", "period_low", "diff", "change", "highest", "lowest", "max_volume", "price", "v",
}


def rounded(df: DataFrame, digits: int = 4, exact: Iterable[str] = PRICE_COLUMNS, exact_digits: int = 8) -> DataFrame:
    exact = set(exact)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = exact_digits if f.name in exact else digits
            cols.append(F.round(F.col(f.name), d).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_round(columns: Iterable[str], digits: int = 4, exact: Iterable[str] = PRICE_COLUMNS,
              exact_digits: int = 8, doubles: Iterable[str] | None = None) -> str:
    """SELECT list that rounds like :func:`rounded` (``doubles`` = the double columns)."""
    exact = set(exact)
    dbl = set(doubles) if doubles is not None else None
    out = []
    for c in columns:
        if dbl is not None and c not in dbl:
            out.append(c)
        else:
            d = exact_digits if c in exact else digits
            out.append(f"round({c}, {d}) AS {c}")
    return ", ".join(out)
