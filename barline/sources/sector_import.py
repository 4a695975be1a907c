"""Nested key/value sector JSON to typed wide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline import schemas


def flatten_payload(texts: DataFrame, level: int) -> DataFrame:
    """One typed row per entry of each JSON array in column ``value``.

    ``entry_no`` is the entry's place in its array, by which later entries overwrite earlier ones.
    Only known keys are kept; of a repeated key the last wins; ``id``, ``level`` and ``type``
    inside ``data`` override the entry's own; entries without an id are dropped. All of it is
    array functions on the entry itself: no explode, no pivot, no shuffle.
    """
    # arrays are read as raw element texts first, so one malformed element (a number where an
    # object belongs) is skipped alone instead of voiding its whole array
    entries = texts.select(F.posexplode(F.from_json("value", "array<string>")).alias("entry_no", "t")).select(
        "entry_no", F.from_json("t", "id string, type string, data array<string>").alias("e")
    )

    def given(key: str) -> Column:
        hits = F.filter(F.col("kv"), lambda kv: kv["key"] == key)
        return F.try_element_at(hits, F.lit(-1))

    def field(key: str, kind: T.DataType | str, default: Column) -> Column:
        hit = given(key)
        return F.when(hit.isNotNull(), hit["value"].try_cast(kind)).otherwise(default).alias(key)

    null = F.lit(None)
    cols = [
        F.col("entry_no"),
        field("id", "int", F.col("e.id").try_cast("int")),
        field("level", "int", F.lit(level)),
        field("type", "string", F.col("e.type")),
        field("name", "string", null.cast("string")),
    ]
    cols += [field(k, schemas.METRIC, null.cast(schemas.METRIC)) for k in schemas.SECTOR_METRICS]
    pairs = F.transform(
        F.coalesce(F.col("e.data"), F.array().cast("array<string>")),
        lambda t: F.from_json(t, "key string, value string"),
    )
    return (
        entries.where(F.col("e").isNotNull())
        .withColumn("kv", pairs)
        .select(*cols)
        .where(F.col("id").isNotNull())
    )


def read_sector_json(spark: SparkSession, path: str, level: int) -> DataFrame:
    """Files holding one JSON array each. Many files are read in parallel."""
    return flatten_payload(spark.read.text(path, wholetext=True), level)
