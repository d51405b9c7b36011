import tempfile

from candlewick.operators.windows import indicator_table
from candlewick.sources.payload import payloads_from_bars
from candlewick.sources.trades import lineitem_bars
from candlewick.streaming.landing import start_ingest

SF = "/root/testdata/sf0.001"


def test_stream_ingest_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="cw-stream-")
    bars = lineitem_bars(spark, SF)
    payloads_from_bars(bars).write.json(f"{root}/landing")
    q = start_ingest(spark, f"{root}/landing", f"{root}/bars", f"{root}/ind", f"{root}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{root}/ind")
    exp = indicator_table(bars, drop_incomplete=False)
    assert got.count() == exp.count()
    assert got.select("symbol", "dt").exceptAll(exp.select("symbol", "dt")).count() == 0
