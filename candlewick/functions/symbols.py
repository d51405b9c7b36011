"""Symbol text functions (F1-F3) and provider candidates (J3 input)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_symbol(ticker: Column) -> Column:
    """text before the first dot, upper case (``RELIANCE.NS`` -> ``RELIANCE``)."""
    return F.upper(F.split_part(ticker, F.lit("."), F.lit(1)))


def provider_b_symbol(ticker: Column) -> Column:
    """``.NSE``/``.NS`` tickers map to ``BASE.BSE``, everything else to ``BASE``."""
    base = base_symbol(ticker)
    indian = ticker.endswith(".NSE") | ticker.endswith(".NS")
    return F.when(indian, F.concat(base, F.lit(".BSE"))).otherwise(base)


def other_provider_symbol(ticker: Column) -> Column:
    """any other provider takes the upper-cased ticker."""
    return F.upper(ticker)


# Provider A suffix preference (NSE, then BSE, then bare).
PROVIDER_A_SUFFIXES = [".NS", ".BO", ""]
PROVIDER_A_DEFAULT_SUFFIX = ".NS"


def provider_a_candidates(ticker: Column, market: str | None = None) -> Column:
    """Candidates in preference order as ``array<struct<rank, candidate>>``.

    By default every ticker tries the Indian suffixes first, as the
    reference does (D34); ``market="US Stocks"`` tries the bare symbol only.
    """
    base = base_symbol(ticker)
    suffixes = [""] if market == "US Stocks" else PROVIDER_A_SUFFIXES
    return F.array(*[
        F.struct(F.lit(i + 1).alias("rank"), F.concat(base, F.lit(s)).alias("candidate"))
        for i, s in enumerate(suffixes)
    ])
