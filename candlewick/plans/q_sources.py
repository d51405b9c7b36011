"""Source, look-up and symbol/money function queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions import grades, money, symbols
from candlewick.functions.dims import INSTRUMENTS, symbol_rows, values_sql
from candlewick.operators import lookups
from candlewick.operators.windows import indicator_table
from candlewick.plans.present import rounded, sql_round
from candlewick.plans.registry import register
from candlewick.plans.sqlkit import BARS, IND_COLUMNS, ORDER_BARS, base_ctes
from candlewick.schema import BAR_COLUMNS, INDICATORS, OHLCV
from candlewick.session import ensure_checkpoint_dir
from candlewick.sources import export, fallback, lookback, payload, wide
from candlewick.sources.trades import lineitem_bars, order_bars


IND_DOUBLES = [*OHLCV, *INDICATORS]


def _bars_as(src: str) -> str:
    return f"SELECT {sql_round(BAR_COLUMNS, doubles=OHLCV)} FROM (SELECT * EXCLUDE (source), '{src}' AS source FROM ({BARS}) b) x"


# header forms of the landed files, and the bar column (or a filler) under each name
LANDED = [
    [("Symbol", "symbol"), ("Date", "dt"), ("Open", "open"), ("High", "high"), ("Low", "low"), ("Close", "close"), ("Volume", "volume")],
    [("Date", "dt"), ("Open", "open"), ("High", "high"), ("Low", "low"), ("Adj Close", "close"), ("Volume", "volume"), ("Symbol", "symbol")],
    [("Volume", "volume"), ("Close", "close"), ("Adj Close", "-1"), ("Dividends", "0"), ("Low", "low"), ("High", "high"), ("Open", "open"), ("Symbol", "symbol"), ("Date", "dt")],
    [("Symbol", "symbol"), ("Date", "dt"), ("Close", "close"), ("Close", "-2"), ("Open", "open"), ("Open", "-3"), ("High", "high"), ("Low", "low"), ("Volume", "volume")],
]


def _land(bars, path: str, form: int) -> None:
    """The bars as CSV files, each with its header line first."""
    from collections.abc import Iterator

    import pyarrow as pa

    header = ",".join(n for n, _ in LANDED[form])
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in bars.columns else F.lit(c) for _, c in LANDED[form]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], names=["value"])

    bars.select(line.alias("value")).mapInArrow(run, "value string").write.mode("append").text(path)


@register("bars_wide", _bars_as("provider_a"))
def q_bars_wide(spark, sf):
    """S1 + N1-N3: bars landed as CSV files of four header forms (``Close``;
    ``Adj Close``; both, permuted, with another column; repeated names), dealt
    by the day of the month, read under their own headers and normalised."""
    import uuid

    b = lineitem_bars(spark, sf)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wide_{uuid.uuid4().hex}"
    for form in range(len(LANDED)):
        _land(b.where(F.dayofmonth("dt") % len(LANDED) == form), path, form)
    return rounded(wide.read_wide(spark, path))


@register("bars_json", _bars_as("provider_b"))
def q_bars_json(spark, sf):
    """Provider-B JSON documents (one per symbol and year) parsed into bars."""
    docs = payload.payloads_from_bars(lineitem_bars(spark, sf))
    return rounded(payload.parse_payload(docs, strict=True))


@register("payload_status", """SELECT o_orderstatus || '-' || o_orderkey AS symbol,
  CASE o_orderkey % 7 WHEN 0 THEN 'ok' WHEN 3 THEN 'error' WHEN 4 THEN 'unknown' WHEN 5 THEN 'connection failed' ELSE 'rate limited' END AS status,
  CASE WHEN o_orderkey % 7 = 3 THEN 'bad symbol ' || o_orderkey END AS message FROM orders""")
def q_payload_status(spark, sf):
    """S3: status of provider-B replies, one an order; the key decides whether
    a reply holds a series, a note, an information, an error, another key, is
    unreadable, or holds an error and a note."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    key = o.o_orderkey.cast("string")
    kinds = [F.lit('{"Time Series (Daily)": {}}'), F.lit('{"Note": "slow down"}'), F.lit('{"Information": "daily limit"}'),
             F.concat(F.lit('{"Error Message": "bad symbol '), key, F.lit('"}')), F.lit('{"other": 1}'), F.lit("<html>gateway</html>"),
             F.lit('{"Error Message": "no", "Note": "slow down"}')]
    reply = F.element_at(F.array(*kinds), (o.o_orderkey % 7 + 1).cast("int"))
    return payload.payload_status(o.select(F.concat("o_orderstatus", F.lit("-"), key).alias("symbol"), reply.alias("payload")))


# some symbols have bars in both tiers, some in the second only, one in neither
TIERS_SQL = f"""li AS ({BARS}), ob AS ({ORDER_BARS}), a AS (SELECT * FROM ob WHERE symbol <> 'P'),
b AS (SELECT * FROM ob UNION ALL SELECT * FROM li WHERE symbol <> 'NO'),
req AS (SELECT DISTINCT symbol FROM li UNION SELECT DISTINCT symbol FROM ob),
tagged AS (SELECT *, 0 AS tier, 'provider_a' AS src FROM a UNION ALL SELECT *, 1 AS tier, 'provider_b' AS src FROM b)"""


def _tiers(spark, sf):
    li, ob = lineitem_bars(spark, sf), order_bars(spark, sf)
    req = li.select("symbol").unionByName(ob.select("symbol"))
    return req, [("provider_a", ob.where("symbol <> 'P'")), ("provider_b", ob.unionByName(li.where("symbol <> 'NO'")))]


@register("source_status", f"""WITH {TIERS_SQL}
SELECT r.symbol, s.source, CAST(coalesce(c.rows, 0) AS BIGINT) AS rows,
  CASE WHEN coalesce(c.rows, 0) > 0 THEN 'has rows' ELSE 'no data' END AS status
FROM req r CROSS JOIN (VALUES ('provider_a'), ('provider_b')) s(source)
LEFT JOIN (SELECT symbol, src, count(*) AS rows FROM tagged GROUP BY symbol, src) c ON c.symbol = r.symbol AND c.src = s.source""")
def q_source_status(spark, sf):
    """Rows per requested symbol and source."""
    req, tiers = _tiers(spark, sf)
    return fallback.source_status(req, tiers)


@register("source_fallback", f"""WITH {TIERS_SQL},
best AS (SELECT symbol, min(tier) AS tier FROM tagged GROUP BY symbol)
SELECT {sql_round(BAR_COLUMNS, doubles=OHLCV)} FROM (
  SELECT t.symbol, dt, open, high, low, close, volume, src AS source FROM tagged t JOIN best USING (symbol, tier)) x""")
def q_source_fallback(spark, sf):
    """Per symbol, the bars of the first source that has them."""
    req, tiers = _tiers(spark, sf)
    bars, _ = fallback.with_fallback(req, tiers)
    return rounded(bars.select(*BAR_COLUMNS))


@register("fallback_trace", f"""WITH {TIERS_SQL},
best AS (SELECT symbol, min(tier) AS tier FROM tagged GROUP BY symbol),
grid AS (SELECT r.symbol, s.tier, s.source FROM req r CROSS JOIN (VALUES (0, 'provider_a'), (1, 'provider_b')) s(tier, source))
SELECT g.symbol, g.tier + 1 AS attempt, g.source, coalesce(g.tier = b.tier, false) AS ok
FROM grid g LEFT JOIN best b USING (symbol) WHERE b.tier IS NULL OR g.tier <= b.tier""")
def q_fallback_trace(spark, sf):
    """The attempts made per symbol and which one succeeded."""
    req, tiers = _tiers(spark, sf)
    _, trace = fallback.with_fallback(req, tiers)
    return trace


PERIODS = ["1mo", "3mo", "6mo", "1y", "2y", "5y", "max"]
_DAYS = "CASE period " + " ".join(f"WHEN '{p}' THEN {lookback.period_days(p)}" for p in PERIODS[:-1]) + " ELSE 365 END"


@register("lookback", f"""WITH bars AS ({BARS}), p AS (SELECT unnest({PERIODS}) AS period)
SELECT period, {sql_round(BAR_COLUMNS, doubles=OHLCV)} FROM bars, p WHERE dt >= (SELECT max(dt) FROM bars) - CAST({_DAYS} AS INTEGER)""")
def q_lookback(spark, sf):
    """S6 + S7: the bars of every period code (and an unknown one) before the
    latest trade date.  That date is one aggregate value, used as a literal, so
    the longest range reaches the one scan of the trades as a pushed filter."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    as_of = str(li.agg(F.max(F.col("l_shipdate").cast("date"))).first()[0])
    return rounded(lookback.lookbacks(lineitem_bars(spark, sf), PERIODS, as_of).select("period", *BAR_COLUMNS))


@register("csv_export", f"WITH {base_ctes()} SELECT {sql_round(IND_COLUMNS, doubles=IND_DOUBLES)} FROM ind")
def q_csv_export(spark, sf):
    """The processed table written as CSV per symbol under the session's
    checkpoint folder, read back with its schema."""
    import uuid

    ind = indicator_table(lineitem_bars(spark, sf)).select(*IND_COLUMNS)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv_export_{uuid.uuid4().hex}"
    export.write_csv(ind, path)
    # the files hold the columns in their written order, the symbol is in the folder names
    written = T.StructType([f for f in ind.schema.fields if f.name != "symbol"] + [ind.schema["symbol"]])
    return rounded(spark.read.schema(written).option("header", True).csv(path).select(*IND_COLUMNS))


@register("csv_export_named", f"""WITH {base_ctes()}, day AS (SELECT max(dt) AS as_of FROM bars)
SELECT symbol || '_stock_data_' || strftime(as_of, '%Y%m%d') AS export, symbol, count(*) AS rows, min(dt) AS first_dt, max(dt) AS last_dt, round(sum(close), 4) AS close_sum
FROM ind, day GROUP BY symbol, as_of""")
def q_csv_export_named(spark, sf):
    """Exports named by ticker and date, read back: the name of each, its rows, range and sum of closes."""
    import uuid

    bars = lineitem_bars(spark, sf)
    as_of = bars.agg(F.max("dt")).collect()[0][0]
    ind = indicator_table(bars).select(*IND_COLUMNS)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv_export_{uuid.uuid4().hex}"
    export.write_csv(ind, path, as_of=as_of)
    written = T.StructType([*ind.schema.fields, T.StructField("export", T.StringType())])
    back = spark.read.schema(written).option("header", True).csv(path)
    return rounded(back.groupBy("export", "symbol").agg(F.count("*").alias("rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"),
                                                        F.sum("close").alias("close_sum")))


# --- look-ups and symbol functions ---------------------------------------------

# requests: listed labels and unlisted ones, dealt to the customers by key
_LABELS = [label for _, label, _ in symbol_rows()] + ["UNLISTED", "brk.b"]
_LABEL_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _LABELS) + f"][c_custkey % {len(_LABELS)} + 1]"


def _label(key):
    return F.element_at(F.array(*map(F.lit, _LABELS)), (key % len(_LABELS) + 1).cast("int"))


def _suffixed(spark, sf, suffixes):
    """ticker per customer: a label and a suffix by key."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    suffix = F.element_at(F.array(*map(F.lit, suffixes)), (F.floor(F.col("c_custkey") / 7) % len(suffixes) + 1).cast("int"))
    return c.select("c_custkey", F.concat(_label(F.col("c_custkey")), suffix).alias("ticker"))


@register("symbol_lookup", f"""WITH dim AS (SELECT * FROM {values_sql(symbol_rows(), ['market', 'label', 'ticker'])}),
req AS (SELECT c_custkey, {_LABEL_SQL} AS label, ['US Stocks', 'Indian Stocks', 'Other'][c_nationkey % 3 + 1] AS market FROM customer)
SELECT c_custkey, r.label, r.market, CASE WHEN r.market IN ('US Stocks', 'Indian Stocks') THEN d.ticker ELSE r.label END AS ticker
FROM req r LEFT JOIN dim d ON d.market = r.market AND d.label = r.label""")
def q_symbol_lookup(spark, sf):
    """(market, label) -> ticker for the requests of the customers."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    market = F.element_at(F.array(*map(F.lit, ("US Stocks", "Indian Stocks", "Other"))), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return lookups.symbol_lookup(spark, c.select("c_custkey", _label(F.col("c_custkey")).alias("label"), market.alias("market")))


INFO_SUFFIXES = ["", ".NS", ".x"]
INFO_SQL = f"""dim AS (SELECT * FROM {values_sql(INSTRUMENTS, ['key', 'name', 'sector', 'industry', 'currency'])}),
t AS (SELECT c_custkey, {_LABEL_SQL} || {INFO_SUFFIXES}[(c_custkey // 7) % 3 + 1] AS ticker FROM customer),
info AS (SELECT t.c_custkey, t.ticker, coalesce(f.name, b.name, t.ticker) AS name, coalesce(f.sector, b.sector, 'Unknown') AS sector,
  coalesce(f.industry, b.industry, 'Unknown') AS industry, coalesce(f.currency, b.currency, 'USD') AS currency
FROM t LEFT JOIN dim f ON f.key = upper(t.ticker) LEFT JOIN dim b ON b.key = upper(split_part(t.ticker, '.', 1)))"""


@register("instrument_info", f"WITH {INFO_SQL} SELECT * FROM info")
def q_instrument_info(spark, sf):
    """Instrument details, with defaults, for the tickers of the customers."""
    return lookups.instrument_info(spark, _suffixed(spark, sf, INFO_SUFFIXES))


HAVE_SUFFIXES = [".NS", ".BO", ""]


@register("symbol_resolution", f"""WITH have AS (SELECT DISTINCT upper(split_part({_LABEL_SQL}, '.', 1)) || {HAVE_SUFFIXES}[(c_custkey // 7) % 3 + 1] AS symbol
          FROM customer WHERE c_custkey % 23 = 0),
t AS (SELECT DISTINCT {_LABEL_SQL} AS ticker FROM customer),
cand AS (SELECT ticker, r, upper(split_part(ticker, '.', 1)) || s AS candidate FROM t,
         (VALUES (1, '.NS'), (2, '.BO'), (3, '')) c(r, s)),
hit AS (SELECT ticker, arg_min(candidate, r) AS resolved FROM cand WHERE candidate IN (SELECT symbol FROM have) GROUP BY ticker)
SELECT t.ticker, coalesce(h.resolved, upper(split_part(t.ticker, '.', 1)) || '.NS') AS resolved FROM t LEFT JOIN hit h USING (ticker)""")
def q_symbol_resolution(spark, sf):
    """Provider-A resolution of the customers' labels against the symbols
    that every 23rd customer stands for (each in one of three forms)."""
    have = _suffixed(spark, sf, HAVE_SUFFIXES).where("c_custkey % 23 = 0")
    base = symbols.base_symbol(_label(F.col("c_custkey")))
    suffix = F.element_at(F.array(*map(F.lit, HAVE_SUFFIXES)), (F.floor(F.col("c_custkey") / 7) % 3 + 1).cast("int"))
    t = spark.read.parquet(f"{sf}/customer.parquet").select(_label(F.col("c_custkey")).alias("ticker")).distinct()
    return lookups.resolve_provider_a(t, have.select(F.concat(base, suffix).alias("symbol")))


@register("symbol_functions", f"""WITH bars AS ({BARS}), t AS (SELECT DISTINCT symbol || s AS ticker FROM bars, (VALUES (''), ('.NS'), ('.nse')) x(s))
SELECT ticker, upper(split_part(ticker, '.', 1)) AS base,
  CASE WHEN ends_with(ticker, '.NSE') OR ends_with(ticker, '.NS') THEN upper(split_part(ticker, '.', 1)) || '.BSE'
       ELSE upper(split_part(ticker, '.', 1)) END AS provider_b, upper(ticker) AS other FROM t""")
def q_symbol_functions(spark, sf):
    """F1-F3 on every bar symbol with exchange suffixes."""
    t = lineitem_bars(spark, sf).select("symbol").distinct().select(
        F.explode(F.array(*[F.concat("symbol", F.lit(s)) for s in ("", ".NS", ".nse")])).alias("ticker")).distinct()
    return t.select("ticker", symbols.base_symbol(F.col("ticker")).alias("base"),
                    symbols.provider_b_symbol(F.col("ticker")).alias("provider_b"),
                    symbols.other_provider_symbol(F.col("ticker")).alias("other"))


@register("money_text", f"""WITH {base_ctes()},
s AS (SELECT symbol, sum(CASE WHEN symbol = 'NO' THEN 0.0 WHEN symbol <> 'RF' THEN volume * close END) AS turnover FROM ind GROUP BY symbol),
c AS (SELECT * FROM (VALUES ('USD'), ('INR'), ('EUR'), ('GBP'), ('JPY'), ('CHF')) v(currency))
SELECT symbol, currency, CASE WHEN turnover IS NOT NULL AND turnover <> 0
  THEN (CASE currency WHEN 'USD' THEN '$' WHEN 'INR' THEN '₹' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'JPY' THEN '¥' ELSE '' END)
       || format('{{:,.0f}}', turnover) ELSE 'N/A' END AS text,
  CASE WHEN currency = 'USD' THEN '$' ELSE 'INR ' END AS parity_prefix FROM s, c""")
def q_money_text(spark, sf):
    """F4 + F8: each symbol's traded value (one zero, one missing) as money text in six currencies."""
    ind = indicator_table(lineitem_bars(spark, sf))
    value = F.when(F.col("symbol") == "NO", 0.0).when(F.col("symbol") != "RF", F.col("volume") * F.col("close"))
    s = ind.groupBy("symbol").agg(F.sum(value).alias("turnover"))
    c = s.withColumn("currency", F.explode(F.array(*[F.lit(x) for x in ("USD", "INR", "EUR", "GBP", "JPY", "CHF")])))
    return c.select("symbol", "currency", money.money_text(F.col("turnover"), F.col("currency")).alias("text"),
                    money.display_currency(F.col("currency"), parity=True).alias("parity_prefix"))


CAP_SQL = """p AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 1000 WHEN c_custkey % 5 = 1 THEN 0.0 END AS quick,
  CASE WHEN c_custkey % 5 IN (0, 2) THEN c_acctbal * 100 END AS profile, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 3 = 1 THEN 0.0 END AS price,
  CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS shares, CASE WHEN c_custkey % 2 = 0 THEN 10.0 END AS last_close FROM customer),
q AS (SELECT *, nullif(coalesce(nullif(price, 0), nullif(last_close, 0)) * nullif(shares, 0), 0) AS product FROM p),
m AS (SELECT c_custkey, coalesce(nullif(quick, 0), nullif(profile, 0), product) AS cap,
  CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN c_custkey || 'B' WHEN 2 THEN '' END AS cap_text,
  CASE WHEN c_custkey % 6 = 0 THEN 'Commodity' ELSE 'Energy' END AS sector FROM q)"""


@register("market_cap", f"""WITH {CAP_SQL}
SELECT c_custkey, round(cap, 2) AS market_cap, CASE WHEN regexp_matches(cap_text, '^[0-9]+$') THEN CAST(cap_text AS BIGINT) END AS cap_from_text,
  CASE WHEN sector = 'Commodity' THEN '—' ELSE 'N/A' END AS cap_display FROM m""")
def q_market_cap(spark, sf):
    """F5 + F6 + F15 on profiles of the customers: by key some have a quick
    value (or zero), some a profile value, some price and shares, some only the
    last close, some nothing; digit and other texts; commodities and others."""
    key, bal = F.col("c_custkey"), F.col("c_acctbal").cast("double")
    cap = money.market_cap(F.when(key % 5 == 0, bal * 1000).when(key % 5 == 1, 0.0), F.when((key % 5).isin(0, 2), bal * 100),
                           F.when(key % 3 == 0, bal).when(key % 3 == 1, 0.0), F.when(key % 4 != 0, F.col("c_nationkey").cast("double")),
                           F.when(key % 2 == 0, 10.0))
    text = F.when(key % 4 == 0, key.cast("string")).when(key % 4 == 1, F.concat(key.cast("string"), F.lit("B"))).when(key % 4 == 2, "")
    sector = F.when(key % 6 == 0, "Commodity").otherwise("Energy")
    return spark.read.parquet(f"{sf}/customer.parquet").select(
        "c_custkey", F.round(cap, 2).alias("market_cap"), money.cap_from_text(text).alias("cap_from_text"),
        money.cap_display(sector, F.lit("N/A")).alias("cap_display"))


@register("profile_fields", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'T' || c_custkey END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'N/A' END AS sector, 'N/A' AS industry,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'N/A' END AS market_cap,
  CASE WHEN c_custkey % 7 = 0 THEN 'INR' ELSE 'USD' END AS currency FROM customer""")
def q_profile_fields(spark, sf):
    """profile documents of the customers, fields missing by key."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    key = F.col("c_custkey")
    doc = F.to_json(F.struct(F.when(key % 2 == 0, F.col("c_name")).alias("longName"), F.when(key % 3 == 0, F.col("c_mktsegment")).alias("sector"),
                             F.when(key % 5 == 0, key).alias("marketCap"), F.when(key % 7 == 0, "INR").alias("currency")))
    p = money.profile_fields(doc, F.concat(F.lit("T"), key.cast("string")))
    return c.select("c_custkey", p.alias("p")).select("c_custkey", "p.*")


@register("r2_grades", """SELECT o_orderkey, CASE WHEN r2 > 0.8 THEN 'excellent' WHEN r2 > 0.6 THEN 'good' WHEN r2 > 0.4 THEN 'moderate' ELSE 'poor' END AS grade
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 100) / 100.0 END AS r2 FROM orders) a""")
def q_r2_grades(spark, sf):
    """F11 over scores of every class, one a order."""
    r2 = F.when(F.col("o_orderkey") % 13 != 0, (F.col("o_orderkey") % 100) / F.lit(100.0))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", grades.r2_grade(r2).alias("grade"))
