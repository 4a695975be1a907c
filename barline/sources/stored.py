"""Stored tables that later jobs profit from: bars bucketed by symbol, and keyed tables that are merged
into part by part."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.series import KEY, RN, with_rn
from barline.session import written
from barline.sources.tables import check_bars

#: Folder column of a keyed table.
PART = "part"


# --- bucketed bars -----------------------------------------------------------------------


def write_bucketed(bars: DataFrame, name: str, path: str, buckets: int = 200) -> None:
    """Write ``bars`` to ``path`` as the table ``name``, bucketed by symbol, with each bar's index in its
    symbol (``rn``) as a column and the order of the files. Rows are dealt by the hash that buckets
    use, so each bucket is one task and one sorted file; a symbol has one bar a day at most, so buckets are as
    even as the symbols are many."""
    (
        with_rn(check_bars(bars).repartition(buckets, KEY))
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, KEY)
        .sortBy(KEY, RN)
        .saveAsTable(name)
    )


def attach_bucketed(spark: SparkSession, name: str, path: str, schema: T.StructType, buckets: int) -> None:
    """Make bars that another session wrote with ``write_bucketed`` known under ``name``. ``schema`` is that
    of the bars."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", {RN} INT"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (symbol) "
        f"SORTED BY (symbol, {RN}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    """Bars of a bucketed table with their index. Windows by symbol over them need neither a shuffle nor a
    sort. A slice by date must drop ``rn``, since warm-ups count from it.

    Sets the session's switch that lets scans tell of sorted buckets; Spark heeds it only where every
    bucket is one file, so a table that was appended to is sorted again, never misread."""
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return check_bars(spark.table(name))


# --- keyed tables ------------------------------------------------------------------------


def with_part(df: DataFrame, key: Sequence[str], parts: int) -> DataFrame:
    return df.withColumn(PART, F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))


def write_keyed(df: DataFrame, path: str, key: Sequence[str], parts: int = 256) -> None:
    """Write a table with unique keys in ``parts`` folders by a hash of the key."""
    with_part(df, key, parts).repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(path)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table without its folder column. ``schema`` is that of the rows; it tells an empty table's too."""
    return _parts_of(spark, path, schema).drop(PART)


def _parts_of(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())])).parquet(path)


def merge_keyed(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    rows: DataFrame,
    key: Sequence[str],
    combine: Callable[[DataFrame, DataFrame], DataFrame],
    parts: int = 256,
) -> list[int]:
    """Copy-on-write merge; the parts that were rewritten.

    ``combine(old, rows)`` is ``operators.tables.replace_by_key`` or ``upsert`` with their options: it may
    change and add rows, never drop any. Only the folders that new keys hash to are read, and of these only
    those whose content changes are written, so other files keep their names and a merge that is run again
    changes nothing. New content is staged beside the table before any folder is replaced; a run that is
    lost half-way is mended by running it again. ``parts`` must be the number the table was written
    with. Not for several writers at a time.
    """
    new = written(with_part(rows, key, parts), "merge-rows")
    touched = [r[PART] for r in new.select(PART).distinct().collect()]  # bounded by ``parts``
    if not touched:
        return []
    old = _parts_of(spark, path, schema).where(F.col(PART).isin(touched))
    merged = with_part(combine(old.drop(PART), new.drop(PART)), key, parts).select(*schema.names, PART)
    staged = written(merged, "merge-staged")
    differs = staged.exceptAll(old.select(*schema.names, PART))
    changed = sorted(r[PART] for r in differs.select(PART).distinct().collect())
    if changed:
        (
            staged.where(F.col(PART).isin(changed))
            .repartition(PART)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(PART)
            .parquet(path)
        )
    return changed
