"""A sample of registered queries against their DuckDB oracle at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["bars", "indicator_table", "rsi", "diagnostics", "supervised_return", "folds",
         "metric_record", "price_path", "importance_linear", "source_fallback", "instrument_info", "bars_wide",
         "lasso_path", "backtest_price", "one_step_price", "csv_export_named"]


def _norm(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(r[i]) if r[i] is not None else "<NULL>" for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "events", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "rsi_state" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm(df.columns, [tuple(r) for r in df.collect()]) == _norm(dcols, cur.fetchall())
