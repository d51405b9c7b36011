"""The oracle results at the small scale reach every branch of the operators."""

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = e.oracle_sql()

    def run(name, columns):
        return con.execute(f"SELECT DISTINCT {columns} FROM ({sql[name]}) x").fetchall()

    return run


@pytest.mark.parametrize("name,column,values", [
    ("payload_status", "status", {"ok", "rate limited", "error", "unknown", "connection failed"}),
    ("source_status", "status", {"has rows", "no data"}),
    ("source_fallback", "source", {"provider_a", "provider_b"}),
    ("lookback", "period", {"1mo", "3mo", "6mo", "1y", "2y", "5y", "max"}),
    ("r2_grades", "grade", {"excellent", "good", "moderate", "poor"}),
    ("market_cap", "cap_display", {"—", "N/A"}),
    ("market_cap", "market_cap IS NULL", {True, False}),
    ("market_cap", "cap_from_text IS NULL", {True, False}),
    ("has_values", "has_ma_50", {True, False}),
    ("has_values", "has_volume_ma", {True, False}),
    ("forecast_status", "status", {"ok", "insufficient history", "no model"}),
    ("symbol_lookup", "ticker IS NULL", {True, False}),
    ("symbol_lookup", "ticker = label", {True, False, None}),
    ("instrument_info", "sector = 'Unknown'", {True, False}),
    ("money_text", "text = 'N/A'", {True, False}),
    ("normalise", "dt IS NULL", {True, False}),
    ("normalise", "volume IS NULL", {True, False}),
    ("fallback_trace", "ok", {True, False}),
])
def test_every_branch_occurs(rows, name, column, values):
    assert {r[0] for r in rows(name, column)} == values


def test_resolution_uses_every_form(rows):
    got = {r[0] for r in rows("symbol_resolution", "CASE WHEN resolved LIKE '%.NS' THEN 'NS' WHEN resolved LIKE '%.BO' THEN 'BO' ELSE 'bare' END")}
    assert got == {"NS", "BO", "bare"}


def test_both_tiers_and_neither(rows):
    got = rows("source_status", "symbol, source, status")
    by = {}
    for s, src, st in got:
        by.setdefault(s, {})[src] = st == "has rows"
    kinds = {(v["provider_a"], v["provider_b"]) for v in by.values()}
    assert {(True, True), (False, True), (False, False)} <= kinds
