"""Reading, checkpoints and Arrow plumbing shared by the operators here."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.session import ensure_checkpoint_dir

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2 MB unless the session names a size: rows can
    be long, and a batch is held by the JVM and a Python worker at once."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "2m")


def release() -> None:
    """Give freed memory back to the system: a Python worker stays between
    tasks, and what its allocators keep counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; the memory is reused by the next task


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that releases memory at the end of its task."""
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def crc_fold(col) -> F.Column:
    """crc32 of the id as text, modulo 4 (the fold that labels are split by)."""
    return F.crc32(col.cast("string").cast("binary")) % 4


def stored(df: DataFrame) -> DataFrame:
    """A compressed table in the shared checkpoint folder, read back: for
    results that several later steps read."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
