"""Scans with pushed-down filters, and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet by default; a path written ``format:path`` reads any other built-in format."""
    fmt, _, rest = path.partition(":")
    if rest and fmt in ("orc", "json", "csv", "delta"):
        reader, path = spark.read.format(fmt), rest
    else:
        reader = spark.read.format("parquet")
    return (reader.schema(schema) if schema is not None else reader).load(path)


def check_bars(df: DataFrame) -> DataFrame:
    """Reject a table whose date is not a DATE: the one-row-per-day bound rests on it."""
    if not isinstance(df.schema["date"].dataType, T.DateType):
        raise TypeError("bars need a DATE column named 'date'; aggregate ticks to days first")
    return df


def unique_bars(df: DataFrame) -> DataFrame:
    """One row per (symbol, date) for a feed that may repeat days; the largest row is kept.

    An aggregate rather than a ranked window, so repeats collapse before the shuffle."""
    rest = [c for c in df.columns if c not in ("symbol", "date")]
    return (
        df.groupBy("symbol", "date")
        .agg(F.max(F.struct(*rest)).alias("r"))
        .select("symbol", "date", *[F.col("r")[c].alias(c) for c in rest])
    )


def in_range(df: DataFrame, start: date | None, end: date | None, order: str = "date") -> DataFrame:
    """Inclusive bounds; literals are compared to the bare column so the scan can use them."""
    if start is not None:
        df = df.where(F.col(order) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(order) <= F.lit(end))
    return df


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line, blanks ignored."""
    symbol = F.trim("value").alias("symbol")
    return spark.read.text(path).select(symbol).where(F.length("symbol") > 0).distinct()


def only_symbols(df: DataFrame, symbols: DataFrame, by: str = "symbol") -> DataFrame:
    """Semi-join on a key table. No broadcast hint: Spark broadcasts it when its measured size
    is under the threshold and shuffles (splitting hot keys under AQE) when it is not."""
    return df.join(symbols.select(F.col(symbols.columns[0]).alias(by)), by, "left_semi")


def filter_bars(
    df: DataFrame,
    symbols: Sequence[str] | DataFrame | None = None,
    start: date | None = None,
    end: date | None = None,
    columns: Sequence[str] | None = None,
    watchlist: DataFrame | None = None,
) -> DataFrame:
    """Conjunction of the optional filters; without symbols the watchlist, if any, decides.

    A list of names becomes a pushed-down IN filter, a table of names a semi-join. An unknown
    symbol gives an empty result, never an error.
    """
    df = in_range(df, start, end)
    if symbols is None or (not isinstance(symbols, DataFrame) and len(symbols) == 0):
        symbols = watchlist
    if isinstance(symbols, DataFrame):
        df = only_symbols(df, symbols)
    elif symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    return df.select(*columns) if columns else df


def load_bars(
    spark: SparkSession,
    path: str,
    symbols: Sequence[str] | DataFrame | None = None,
    start: date | None = None,
    end: date | None = None,
    columns: Sequence[str] | None = None,
    watchlist: DataFrame | None = None,
) -> DataFrame:
    """Daily bars. Rows come back unordered; sort at the point of presentation (``sorted_bars``),
    a global sort inside a pipeline would be a wasted range shuffle."""
    bars = check_bars(read_table(spark, path, schemas.BARS))
    return filter_bars(bars, symbols, start, end, columns, watchlist)


def load_features(
    spark: SparkSession,
    path: str,
    symbols: Sequence[str] | DataFrame | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    return filter_bars(check_bars(read_table(spark, path)), symbols, start, end)


def sorted_bars(df: DataFrame) -> DataFrame:
    return df.orderBy("symbol", "date")


def sector_series(
    df: DataFrame, level: int, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Index series of one sector level."""
    return in_range(df.where(F.col("sector_type") == F.lit(level)), start, end)


def reports_for(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Reports of one symbol (given in any case), or all."""
    return df if not symbol else df.where(F.col("mack") == F.lit(symbol.upper()))


def date_range(as_of: date, days: int = 365) -> tuple[Column, Column]:
    """[as_of - days, as_of] as two columns; the as-of date is always explicit."""
    end = F.lit(as_of).cast("date")
    return F.date_sub(end, days), end


def last_days(df: DataFrame, as_of: date, days: int = 365, order: str = "date") -> DataFrame:
    lo, hi = date_range(as_of, days)
    return df.where((F.col(order) >= lo) & (F.col(order) <= hi))


def write_bars(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Year partitions, rows clustered by symbol inside files, so that date ranges prune folders
    and symbol filters prune row groups.

    Range partitioning by (year, symbol) gives each task a contiguous slice: few files per year,
    and no year or symbol is ever one task's whole load.
    """
    out = df.withColumn("year", F.year("date"))
    (
        out.repartitionByRange("year", "symbol")
        .sortWithinPartitions("year", "symbol", "date")
        .write.mode(mode)
        .partitionBy("year")
        .parquet(path)
    )


def write_table(df: DataFrame, path: str, mode: str = "overwrite", *partition_by: str) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
