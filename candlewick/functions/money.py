"""Money and market-cap column logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency code -> symbol used in money text.
CURRENCY_SYMBOLS = {"USD": "$", "INR": "₹", "EUR": "€", "GBP": "£", "JPY": "¥"}


def currency_symbol(currency: Column) -> Column:
    m = F.create_map(*[x for k, v in CURRENCY_SYMBOLS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.upper(currency)), F.lit(""))


def money_text(value: Column, currency: Column) -> Column:
    """``$1,234`` style text, 0 decimals (half-even); missing or 0 -> ``N/A``."""
    ok = value.isNotNull() & (value != 0) & ~F.isnan(value)
    return F.when(ok, F.concat(currency_symbol(currency), F.format_number(value, 0))).otherwise(F.lit("N/A"))


def _nz(c: Column) -> Column:
    """Python truthiness for a number: 0 and NaN count as missing."""
    return F.when((c != 0) & ~F.isnan(c), c)


def market_cap(quick_cap: Column, profile_cap: Column, price: Column, shares: Column,
               last_close: Column | None = None) -> Column:
    """first non-zero of quick value, profile value, price x shares.

    ``price`` falls back to the last close; the product needs both parts.
    """
    p = F.coalesce(_nz(price), _nz(last_close) if last_close is not None else F.lit(None).cast("double"))
    s = _nz(shares)
    return F.coalesce(_nz(quick_cap), _nz(profile_cap), _nz(p * s))


def cap_from_text(text: Column) -> Column:
    """digit-only text -> BIGINT, anything else NULL."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def display_currency(currency: Column, parity: bool = False) -> Column:
    """F8: currency prefix for display.

    ``parity=True`` reproduces the reference (``$`` for USD, ``INR `` for
    every other code); the default uses the F4 symbol map.
    """
    if parity:
        return F.when(F.upper(currency) == "USD", F.lit("$")).otherwise(F.lit("INR "))
    return currency_symbol(currency)


def cap_display(sector: Column, cap_text: Column) -> Column:
    """commodities show no market cap."""
    return F.when(sector == "Commodity", F.lit("—")).otherwise(cap_text)


def profile_fields(payload: Column, ticker: Column) -> Column:
    """name, sector, industry, cap and currency from a profile JSON, with defaults."""
    def get(key: str) -> Column:
        return F.get_json_object(payload, f"$.{key}")

    return F.struct(
        F.coalesce(get("longName"), ticker).alias("name"),
        F.coalesce(get("sector"), F.lit("N/A")).alias("sector"),
        F.coalesce(get("industry"), F.lit("N/A")).alias("industry"),
        F.coalesce(get("marketCap"), F.lit("N/A")).alias("market_cap"),
        F.coalesce(get("currency"), F.lit("USD")).alias("currency"),
    )
