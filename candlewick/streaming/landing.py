"""Incremental ingestion of landed provider-B documents.

The reference refetches a symbol's whole history on demand and caches it
for five minutes.  On Spark the same freshness is a file-source stream:
new JSON-lines files of ``(symbol, payload)`` in a landing folder are
parsed into bars (stateless: ``from_json`` + ``explode``) and written to a
bars table partitioned by batch and symbol; a batch that runs again
overwrites its own folder, so a retry lands nothing twice.  Of a date landed
more than once the latest batch counts, so corrections win.  The indicator
table is rewritten only for the symbols a micro-batch touched (dynamic
partition overwrite; the join on the partition column prunes the read).
Checkpoints live where the caller says -- on a cluster, a shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from candlewick.operators.windows import indicator_table
from candlewick.schema import BAR_SCHEMA
from candlewick.sources.payload import parse_payload

PAYLOAD_SCHEMA = "symbol string, payload string"


def payload_stream(spark: SparkSession, landing_dir: str, max_files: int = 1000) -> DataFrame:
    """Streaming bars from JSON-lines files of (symbol, payload)."""
    raw = spark.readStream.schema(PAYLOAD_SCHEMA).option("maxFilesPerTrigger", max_files).json(landing_dir)
    return parse_payload(raw, strict=False)


def refresh_indicators(spark: SparkSession, bars_dir: str, indicators_dir: str):
    """``foreachBatch`` handler: write the batch's bars, then rebuild the
    indicator table of the touched symbols only."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        folder = f"{bars_dir}/batch={batch_id}"
        batch.where(F.col("dt").isNotNull()).write.mode("overwrite").partitionBy("symbol").parquet(folder)
        stored = spark.read.schema(T.StructType([*BAR_SCHEMA.fields, T.StructField("batch", T.LongType())])).parquet(bars_dir)
        touched = stored.where(F.col("batch") == batch_id).select("symbol").distinct()
        bars = stored.where(F.col("batch") <= batch_id).join(touched, "symbol", "left_semi")
        # of a date landed twice the latest batch counts; inside one batch the largest value tuple
        cols = ("batch", "open", "high", "low", "close", "volume", "source")
        latest = bars.groupBy("symbol", "dt").agg(F.max(F.struct(*cols)).alias("_b")).select(
            "symbol", "dt", *[F.col(f"_b.{c}").alias(c) for c in cols[1:]])
        ind = indicator_table(latest, drop_incomplete=False)
        (ind.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("symbol").parquet(indicators_dir))

    return handle


def start_ingest(spark: SparkSession, landing_dir: str, bars_dir: str, indicators_dir: str,
                 checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """Start the ingest; ``available_now`` processes what is landed and stops."""
    w = payload_stream(spark, landing_dir).writeStream.foreachBatch(
        refresh_indicators(spark, bars_dir, indicators_dir)).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="300 seconds")
    return w.start()
