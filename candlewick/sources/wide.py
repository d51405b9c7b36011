"""Wide OHLCV frames as landed by provider A.

Columns arrive as text with the provider's names (``Date``, ``Open``,
``High``, ``Low``, ``Close`` or ``Adj Close``, ``Volume``), perhaps more
than once, and not the same in every file.  Normalisation is one projection:
positions are renamed first, so the first of repeated names wins; ``Close`` falls back to ``Adj Close``;
unparseable dates and numbers become NULL (``try_*``), never errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.schema import BAR_COLUMNS, OHLCV

# Provider A column names -> bar columns.
WIDE_NAMES = {"Date": "dt", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}
ADJ_CLOSE = "Adj Close"


def to_double(c: Column) -> Column:
    """Text or number -> DOUBLE; bad text, NaN and +/-inf -> NULL."""
    d = c.cast("string").try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def to_date(c: Column) -> Column:
    """text/timestamp -> DATE; unparseable -> NULL."""
    return F.coalesce(F.try_to_timestamp(c.cast("string")).cast("date"),
                      F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd")).cast("date"))


def normalise_wide(df: DataFrame, symbol: Column | str | None = None, source: str = "provider_a") -> DataFrame:
    """Any wide frame -> bar schema (symbol, dt, OHLCV, source)."""
    names = df.columns
    first: dict[str, int] = {}
    for pos, n in enumerate(names):
        first.setdefault(n, pos)
    pos_df = df.toDF(*[f"_c{i}" for i in range(len(names))])

    def col(name: str) -> Column | None:
        return F.col(f"_c{first[name]}") if name in first else None

    if "Close" not in first and ADJ_CLOSE in first:
        first["Close"] = first[ADJ_CLOSE]
    sym = (F.col(f"_c{first[symbol]}") if isinstance(symbol, str) and symbol in first
           else symbol if isinstance(symbol, Column) else F.lit(symbol))
    out = [sym.cast("string").alias("symbol")]
    for src, dst in WIDE_NAMES.items():
        c = col(src)
        if dst == "dt":
            out.append((to_date(c) if c is not None else F.lit(None).cast("date")).alias("dt"))
        else:
            out.append((to_double(c) if c is not None else F.lit(None).cast("double")).alias(dst))
    out.append(F.lit(source).alias("source"))
    return pos_df.select(*out).select(*BAR_COLUMNS)


def header_index(spark: SparkSession, path: str) -> DataFrame:
    """file, line: the header (first line with text) of every CSV file.

    Splits that start a file are the only ones looked at; of those, the first
    row by position is the header, found by a partial aggregate per file.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    first = lines.where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != "")).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("line"), F.monotonically_increasing_id().alias("at"))
    return first.groupBy("file").agg(F.min_by("line", "at").alias("line"))


def _positions(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])


def read_landed(spark: SparkSession, path: str, symbol_col: str = "Symbol", source: str = "provider_a") -> DataFrame:
    """S1 + N1-N3 over CSV files that need not agree in their header.

    Every file's rows are read by position and named by that file's own header:
    the header index joins to the rows by file, and a column is the first
    position of its name (``Close``, else ``Adj Close``).  A file without a
    column has NULL there; columns of other names are ignored.
    """
    heads = header_index(spark, path)
    # one number: the widest header, an upper bound where a quoted name holds a comma
    width = heads.agg(F.max(F.size(F.split("line", ",")))).first()[0] or 1
    schema = _positions(width)
    names = F.array(*[F.trim(F.col(f"_h.{f}")) for f in schema.names])
    wanted = {dst: src for src, dst in WIDE_NAMES.items()} | {"symbol": symbol_col}
    at = {dst: F.array_position("_names", src) for dst, src in wanted.items()}
    at["close"] = F.when(at["close"] > 0, at["close"]).otherwise(F.array_position("_names", ADJ_CLOSE))
    index = heads.select("file", F.from_csv("line", schema.simpleString()[len("struct<"):-1].replace(":", " ")).alias("_h")).select(
        "file", names.alias("_names")).select("file", *[pos.cast("int").alias(f"_at_{dst}") for dst, pos in at.items()])
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.array(*schema.names).alias("_v")).join(index, "file")

    def value(dst: str) -> Column:
        return F.when(F.col(f"_at_{dst}") > 0, F.try_element_at("_v", F.col(f"_at_{dst}")))

    return rows.select(value("symbol").alias("symbol"), to_date(value("dt")).alias("dt"),
                       *[to_double(value(c)).alias(c) for c in OHLCV], F.lit(source).alias("source")).select(*BAR_COLUMNS)


def read_wide(spark: SparkSession, path: str, fmt: str = "csv", symbol_col: str = "Symbol",
              source: str = "provider_a") -> DataFrame:
    """Landed CSV/Parquet files of wide bars.  CSV files are read under
    their own headers (:func:`read_landed`); Parquet files name their columns
    themselves and must agree in them."""
    if fmt == "csv":
        return read_landed(spark, path, symbol_col, source)
    return normalise_wide(spark.read.format(fmt).load(path), symbol_col, source)
