"""Physical-plan properties the scale design relies on."""

import pathlib
import re

from pyspark.sql import functions as F

from candlewick.operators import forecast as fc
from candlewick.operators import lookups
from candlewick.operators import supervised as sv
from candlewick.operators.windows import indicator_table
from candlewick.sources import lookback
from candlewick.sources.trades import lineitem_bars

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_trade_aggregation_combines_before_shuffle(spark):
    spark.catalog.clearCache()
    p = plan(lineitem_bars(spark, SF))
    lines = p.split("\n")
    ex = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert any("partial_min_by" in line for line in lines[ex:]), p


def test_all_periods_share_one_scan_with_the_longest_range_pushed(spark):
    p = plan(lookback.lookbacks(lineitem_bars(spark, SF), ["1mo", "5y", "1y", "max"], "1998-12-01"))
    assert p.count("FileScan") == 1
    assert re.search(r"l_shipdate#\d+ >= 1993-12-0", p), p


def test_segmented_price_path_sums_no_whole_symbol(spark):
    preds = spark.range(1000).selectExpr("'S' AS symbol", "CAST(id AS INT) AS step", "1.0D AS y_hat")
    base = spark.createDataFrame([("S", 1.0)], "symbol string, base_price double")
    p = plan(fc.price_path(preds, base, segment_rows=50))
    over_rows = [w for w in re.findall(r"Window \[.*", p) if "_sum0" not in w and "_bad0" not in w and "_off" not in w and "_n#" not in w and "_w0" not in w]
    assert all("_seg" in w or "_bucket" in w for w in over_rows), over_rows


def test_trades_to_folds_in_two_exchanges(spark):
    spark.catalog.clearCache()  # a cached frame from another test would replace part of the plan
    df = sv.folds(sv.supervised(indicator_table(lineitem_bars(spark, SF))), 5)
    ex = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))
    assert len(ex) == 2, ex


def formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_lookback_predicate_reaches_trade_scan(spark):
    p = formatted(lookback.lookback(lineitem_bars(spark, SF), "1y", "2001-01-01"))
    pushed = [line for line in p.split("\n") if line.startswith("PushedFilters")]
    assert any("GreaterThanOrEqual(l_shipdate" in line for line in pushed), pushed


def test_dimensions_are_broadcast(spark):
    t = lineitem_bars(spark, SF).select(F.col("symbol").alias("ticker")).distinct()
    assert "BroadcastHashJoin" in plan(lookups.instrument_info(spark, t))


def test_forecast_state_limits_rows_before_shuffle(spark):
    p = plan(fc.initial_state(lineitem_bars(spark, SF)))
    assert "WindowGroupLimit" in p


def test_no_local_checkpoint_in_library():
    root = pathlib.Path(__file__).resolve().parent.parent / "candlewick"
    for f in root.rglob("*.py"):
        assert "localCheckpoint(" not in f.read_text(), f
