"""Exact ordered windows over a hot symbol, split into bounded tasks.

A plain ``Window.partitionBy("symbol")`` puts a whole symbol into one task.
For daily bars that is bounded by the calendar; intraday bars of a symbol
that holds a third of all rows would not be.  Every window in this library
looks back at most ``MAX_BACK`` rows and forward at most a few, so a
series can be cut into segments of ``seg_rows`` rows, each carrying a halo
of the rows its frames reach into:

1. positions without a whole-symbol sort: rows per (symbol, time bucket)
   by one aggregation, running offsets over the (small) bucket table, then
   ``row_number`` inside each bucket only;
2. ``_seg = pos div seg_rows``; a row within ``back`` rows of the end of
   its segment is also emitted into the next segment (and within ``fwd``
   rows of the start into the previous one), flagged ``_halo``;
3. windows ``partitionBy(symbol, _seg).orderBy(dt)``; halo rows are
   dropped afterwards.

Results equal the unsegmented windows exactly; each task holds at most
``seg_rows + back + fwd`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BACK = 55      # MA_50 / lag chains reach 50 rows back; margin for RSI and returns
DEFAULT_SEG_ROWS = 100_000


def time_bucket(df: DataFrame, col: str = "dt") -> Column:
    """Coarse bucket of the ordering column: year for dates, day for timestamps."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.DateType):
        return F.year(col)
    return F.to_date(F.col(col)).cast("string")


def with_positions(df: DataFrame, partition: Sequence[str] = ("symbol",), order: str | Sequence[str] = "dt",
                   bucket: Column | None = None) -> DataFrame:
    """Adds ``_pos`` (0-based row position in the partition by ``order``) and
    ``_n`` (rows of the partition) using only bucket-bounded windows.

    ``bucket`` must be monotone in ``order`` (default: the time bucket of the
    first order column); rows are ranked inside their bucket only.
    """
    keys = list(partition)
    order = [order] if isinstance(order, str) else list(order)
    b = df.withColumn("_bucket", bucket if bucket is not None else time_bucket(df, order[0]))
    counts = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*keys, "_bucket", (F.sum("_c").over(wb) - F.col("_c")).alias("_off"),
                            F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
    j = b.join(offsets, [*keys, "_bucket"])
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return j.withColumn("_pos", F.col("_off") + F.row_number().over(w) - 1).drop("_bucket", "_off")


def segment(df: DataFrame, seg_rows: int = DEFAULT_SEG_ROWS, back: int = MAX_BACK, fwd: int = 1) -> DataFrame:
    """Adds ``_seg`` and ``_halo`` and duplicates halo rows (needs ``_pos``)."""
    if seg_rows <= back + fwd:
        raise ValueError("seg_rows must exceed the halo")
    fwd_ok = F.lit(fwd > 0)
    seg = F.floor(F.col("_pos") / F.lit(seg_rows)).cast("long")
    r = F.col("_pos") % F.lit(seg_rows)
    has_next = (seg + 1) * F.lit(seg_rows) < F.col("_n") if "_n" in df.columns else F.lit(True)
    entries = F.array(
        F.struct(seg.alias("s"), F.lit(False).alias("h")),
        F.when((r >= F.lit(seg_rows - back)) & has_next, F.struct((seg + 1).alias("s"), F.lit(True).alias("h"))),
        F.when(fwd_ok & (r < F.lit(fwd)) & (seg > 0), F.struct((seg - 1).alias("s"), F.lit(True).alias("h"))),
    )
    x = df.withColumn("_e", F.explode(F.filter(entries, lambda e: e.isNotNull())))
    return x.withColumn("_seg", F.col("_e.s")).withColumn("_halo", F.col("_e.h")).drop("_e")


def segment_window(partition: Sequence[str] = ("symbol",), order: str = "dt"):
    return Window.partitionBy(*partition, "_seg").orderBy(order)
