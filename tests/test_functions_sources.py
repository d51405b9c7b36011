import datetime as dt

import pytest
from pyspark.sql import functions as F

from candlewick.functions import calendar as cal
from candlewick.functions import grades, money, symbols
from candlewick.operators import lookups
from candlewick.schema import validate_bars
from candlewick.sources import fallback, lookback, payload, wide


def test_symbol_functions(spark):
    t = spark.createDataFrame([("RELIANCE.NS",), ("BRK.B",), ("AAPL",), ("X.NSE",), ("tcs.ns",)], "ticker string")
    r = {x.ticker: x for x in t.select("ticker", symbols.base_symbol(F.col("ticker")).alias("b"),
                                           symbols.provider_b_symbol(F.col("ticker")).alias("p"),
                                           symbols.other_provider_symbol(F.col("ticker")).alias("o")).collect()}
    assert r["RELIANCE.NS"].b == "RELIANCE" and r["RELIANCE.NS"].p == "RELIANCE.BSE"
    assert r["BRK.B"].b == "BRK" and r["BRK.B"].p == "BRK"
    assert r["X.NSE"].p == "X.BSE" and r["AAPL"].p == "AAPL"
    assert r["tcs.ns"].b == "TCS" and r["tcs.ns"].p == "TCS" and r["tcs.ns"].o == "TCS.NS"


def test_instrument_lookup(spark):
    t = spark.createDataFrame([("RELIANCE.NS",), ("BRK.B",), ("AAPL",), ("HCLTECH.NS",), ("zzz",)], "ticker string")
    r = {x.ticker: x for x in lookups.instrument_info(spark, t).collect()}
    assert r["RELIANCE.NS"].currency == "INR" and r["AAPL"].name == "Apple Inc."
    assert r["BRK.B"].name == "Berkshire Hathaway Inc."
    assert r["HCLTECH.NS"].sector == "Unknown" and r["zzz"].name == "zzz" and r["zzz"].currency == "USD"


def test_symbol_lookup_and_resolution(spark, make_bars):
    req = spark.createDataFrame([("US Stocks", "BRK.B"), ("Indian Stocks", "TCS"), ("Other", "xyz"),
                                 ("US Stocks", "NOPE")], "market string, label string")
    r = {(x.market, x.label): x.ticker for x in lookups.symbol_lookup(spark, req).collect()}
    assert r[("US Stocks", "BRK.B")] == "BRK-B" and r[("Indian Stocks", "TCS")] == "TCS.NS"
    assert r[("Other", "xyz")] == "xyz" and r[("US Stocks", "NOPE")] is None
    bars = make_bars([1.0, 2.0], "INFY.BO").unionByName(make_bars([1.0], "AAPL"))
    t = spark.createDataFrame([("INFY.NS",), ("AAPL",), ("NONE",)], "ticker string")
    r = {x.ticker: x.resolved for x in lookups.resolve_provider_a(t, bars).collect()}
    assert r == {"INFY.NS": "INFY.BO", "AAPL": "AAPL", "NONE": "NONE.NS"}


def test_money_and_grades(spark):
    df = spark.createDataFrame([(1234567.5, "USD"), (0.0, "INR"), (None, "EUR"), (2.5, "XXX")], "v double, c string")
    r = [x.t for x in df.select(money.money_text(F.col("v"), F.col("c")).alias("t")).collect()]
    assert r == ["$1,234,568", "N/A", "N/A", "2"]
    g = spark.createDataFrame([(0.9,), (0.7,), (0.5,), (0.1,), (None,)], "r double")
    assert [x.g for x in g.select(grades.r2_grade(F.col("r")).alias("g")).collect()] == [
        "excellent", "good", "moderate", "poor", "poor"]
    s = spark.createDataFrame([(3.0,), (1.0,), (-1.0,), (-3.0,)], "p double")
    assert [x.s for x in s.select(grades.signal(F.col("p")).alias("s")).collect()] == [
        "strong bullish", "mild bullish", "neutral", "bearish"]


def test_market_cap_rules(spark):
    df = spark.createDataFrame([(0.0, 5.0, 2.0, 3.0, 9.0), (None, None, 0.0, 3.0, 4.0), (None, None, None, None, 4.0)],
                               "q double, p double, pr double, sh double, lc double")
    r = [x.m for x in df.select(money.market_cap(F.col("q"), F.col("p"), F.col("pr"), F.col("sh"), F.col("lc"))
                                .alias("m")).collect()]
    assert r == [5.0, 12.0, None]
    t = spark.createDataFrame([("123",), ("12a",), ("",)], "t string")
    assert [x.c for x in t.select(money.cap_from_text(F.col("t")).alias("c")).collect()] == [123, None, None]


def test_friday_forecast_dates_distinct(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, 5),)], "d date")  # a Friday
    r = d.select(*[cal.business_days_after(F.col("d"), i).alias(f"s{i}") for i in range(1, 11)]).first()
    got = list(r)
    assert got[0] == dt.date(2024, 1, 8) and len(set(got)) == 10 and all(x.weekday() < 5 for x in got)
    assert d.select(cal.next_business_day(F.col("d"))).first()[0] == dt.date(2024, 1, 8)
    sat = spark.createDataFrame([(dt.date(2024, 1, 6),)], "d date")
    assert sat.select(cal.business_days_after(F.col("d"), 1)).first()[0] == dt.date(2024, 1, 8)


def test_bad_dates_and_numbers(spark):
    raw = spark.createDataFrame([("S", "2024-01-02", "1", "2", "0.5", "1.5", "1.4", "10"),
                                 ("S", "not a date", "x", "2", "0.5", "1.5", "1.4", "NaN"),
                                 ("S", "2024-01-04", "1", "2", "0.5", "abc", "1.4", "")],
                                "Symbol string, Date string, Open string, High string, Low string, Close string, `Adj Close` string, Volume string")
    r = wide.normalise_wide(raw, "Symbol").orderBy("open").collect()
    rows = {(x.dt, x.close, x.volume) for x in r}
    assert (dt.date(2024, 1, 2), 1.5, 10.0) in rows
    assert (None, 1.5, None) in rows and (dt.date(2024, 1, 4), None, None) in rows


def test_adj_close_fallback_and_first_duplicate(spark):
    raw = spark.createDataFrame([("2024-01-02", "1", "2", "0.5", "1.4", "10", "99")],
                                "Date string, Open string, High string, Low string, `Adj Close` string, Volume string, Open2 string")
    raw = raw.toDF("Date", "Open", "High", "Low", "Adj Close", "Volume", "Open")
    r = wide.normalise_wide(raw, "T").first()
    assert r.close == 1.4 and r.open == 1.0


def test_repeated_key_fails(spark, make_bars):
    b = make_bars([1.0, 2.0])
    with pytest.raises(ValueError):
        validate_bars(b.unionByName(b.limit(1)))
    validate_bars(b)


def test_payload_parse_and_status(spark, make_bars):
    good = payload.payloads_from_bars(make_bars([1.0, 2.0, 3.0], "S"))
    bars = payload.parse_payload(good).collect()
    assert len(bars) == 3 and {x.close for x in bars} == {1.0, 2.0, 3.0}
    bad = spark.createDataFrame([
        ("B", '{"Time Series (Daily)": {"2024-01-02": {"1. open": "1", "2. high": "x", "3. low": "1", "4. close": "1", "5. volume": "1"}}}'),
        ("N", '{"Note": "slow down"}'), ("I", '{"Information": "limit"}'), ("E", '{"Error Message": "bad symbol"}'),
        ("U", '{"other": 1}'), ("X", "<html>")], "symbol string, payload string")
    st = {x.symbol: (x.status, x.message) for x in payload.payload_status(bad).collect()}
    assert st == {"B": ("ok", None), "N": ("rate limited", None), "I": ("rate limited", None),
                  "E": ("error", "bad symbol"), "U": ("unknown", None), "X": ("connection failed", None)}
    assert payload.parse_payload(bad.where("symbol = 'B'"), strict=True).count() == 0
    lenient = payload.parse_payload(bad.where("symbol = 'B'")).first()
    assert lenient.high is None and lenient.close == 1.0


def test_fallback_a_only_b_only_neither(spark, make_bars):
    a = make_bars([1.0, 2.0], "A").unionByName(make_bars([5.0], "AB"))
    b = make_bars([3.0], "B").unionByName(make_bars([7.0, 8.0, 9.0], "AB"))
    req = spark.createDataFrame([("A",), ("B",), ("AB",), ("NONE",)], "symbol string")
    bars, trace = fallback.with_fallback(req, [("a", a), ("b", b)])
    got = {(x.symbol, x.source) for x in bars.collect()}
    assert got == {("A", "a"), ("B", "b"), ("AB", "a")}
    t = {(x.symbol, x.attempt, x.ok) for x in trace.collect()}
    assert ("B", 1, False) in t and ("B", 2, True) in t and ("NONE", 2, False) in t and ("A", 2, False) not in t
    st = {(x.symbol, x.source): x.status for x in fallback.source_status(req, [("a", a), ("b", b)]).collect()}
    assert st[("NONE", "a")] == "no data" and st[("AB", "b")] == "has rows"


def test_lookback_days(spark, make_bars):
    b = make_bars([1.0] * 400)
    assert lookback.period_days("5y") == 1825 and lookback.period_days("odd") == 365
    got = lookback.lookback(b, "1mo", "2024-12-31")
    assert got.agg(F.min("dt")).first()[0] == dt.date(2024, 12, 1)
    assert got.count() == 65  # no upper bound: 31 days of December + the 34 bars after it


def test_lookback_filter_reaches_parquet_scan(spark, make_bars):
    import tempfile

    d = tempfile.mkdtemp(prefix="cw-lb-")
    make_bars([1.0] * 400).write.parquet(d + "/bars")
    got = lookback.lookback(spark.read.parquet(d + "/bars"), "1y", "2024-12-31")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(dt" in plan


def test_profile_fields_defaults(spark):
    df = spark.createDataFrame([('{"longName": "Acme", "sector": "Tech", "marketCap": 5, "currency": "EUR"}', "ACM"),
                                ("{}", "ZZZ")], "payload string, ticker string")
    r = df.select(money.profile_fields(F.col("payload"), F.col("ticker")).alias("p")).collect()
    assert r[0].p.name == "Acme" and r[0].p.industry == "N/A" and r[0].p.currency == "EUR" and r[0].p.market_cap == "5"
    assert r[1].p.name == "ZZZ" and r[1].p.sector == "N/A" and r[1].p.market_cap == "N/A" and r[1].p.currency == "USD"
    assert df.select(money.cap_display(F.lit("Commodity"), F.lit("$5")).alias("c")).first().c == "—"


def test_csv_export_partitioned_with_header(spark, make_bars):
    import os
    import tempfile

    from candlewick.sources import export

    d = tempfile.mkdtemp(prefix="cw-csv-") + "/out"
    export.write_csv(make_bars([1.0, 2.0], "A").unionByName(make_bars([3.0], "B")), d)
    assert sorted(x for x in os.listdir(d) if x.startswith("symbol=")) == ["symbol=A", "symbol=B"]
    back = spark.read.option("header", True).csv(d)
    assert back.count() == 3 and "close" in back.columns


def test_csv_export_named_by_day(spark, make_bars, tmp_path):
    import os

    from candlewick.sources import export

    d = str(tmp_path / "out")
    for day in (dt.date(2024, 3, 1), dt.date(2024, 3, 2)):
        export.write_csv(make_bars([1.0, 2.0], "A").unionByName(make_bars([3.0], "B")), d, as_of=day)
    export.write_csv(make_bars([5.0], "A"), d, as_of=dt.date(2024, 3, 2))  # the same day again
    assert {x for x in os.listdir(d) if x.startswith("export=")} == {f"export={s}_stock_data_2024030{k}" for s in "AB" for k in (1, 2)}
    back = spark.read.option("header", True).csv(d)
    assert {(r["export"], r["close"]) for r in back.collect()} == {
        ("A_stock_data_20240301", "1.0"), ("A_stock_data_20240301", "2.0"), ("A_stock_data_20240302", "5.0"),
        ("B_stock_data_20240301", "3.0"), ("B_stock_data_20240302", "3.0")}
