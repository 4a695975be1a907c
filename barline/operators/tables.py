"""Row validation, lookups and batch forms of single-row table edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import scalars as S

REASONS = "reasons"


def _check(name: str, ok: Column) -> Column:
    return F.when(~S.safe(ok), F.lit(name))


def position_checks() -> list[Column]:
    return [
        _check("ticker length", F.length("ticker").between(1, 10)),
        _check("quantity", F.col("quantity") > 0),
        _check("purchase_price", F.col("purchase_price") > 0),
        _check("purchase_date", F.col("purchase_date").isNotNull()),
    ]


def transaction_checks() -> list[Column]:
    return [
        _check("ticker length", F.length("ticker").between(1, 10)),
        _check("transaction_type", F.col("transaction_type").isin("buy", "sell")),
        _check("quantity", F.col("quantity") > 0),
        _check("price", F.col("price") > 0),
        _check("fees", F.coalesce(F.col("fees") >= 0, F.lit(True))),
        _check("transaction_date", F.col("transaction_date").isNotNull()),
    ]


def request_checks() -> list[Column]:
    return [
        _check("position_id", F.col("position_id") > 0),
        _check("quantity_to_close", F.col("quantity_to_close") > 0),
        _check("closing_price", F.col("closing_price") > 0),
        _check("fees", F.coalesce(F.col("fees") >= 0, F.lit(True))),
    ]


def validate(df: DataFrame, checks: Sequence[Column]) -> DataFrame:
    """Add the array of broken rules (empty for a valid row); one projection, no shuffle."""
    return df.withColumn(REASONS, F.array_compact(F.array(*checks)))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size(REASONS) == 0).drop(REASONS)


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size(REASONS) > 0)


def normalize_positions(df: DataFrame) -> DataFrame:
    """Form input: upper-case trimmed ticker, whole quantity, price to two decimals."""
    return df.withColumns(
        {
            "ticker": S.normal_ticker(F.col("ticker")),
            "quantity": F.floor("quantity"),
            "purchase_price": F.round("purchase_price", 2),
        }
    )


def lookup(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key columns appear in ``keys``: many point lookups as one semi-join."""
    return df.join(keys, list(keys.columns), "left_semi")


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def delete_by_key(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def last_of_key(rows: DataFrame, key: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """(key, ``_new``): the given fields of the row that comes last in ``order``, as if the rows were
    written one after another. Repeated keys shrink to one row before the shuffle."""
    picked = rows.groupBy(*key).agg(*[F.max_by(c, order).alias(c) for c in fields])
    return picked.select(*key, F.struct(F.lit(True).alias("_hit"), *fields).alias("_new"))


def replace_by_key(df: DataFrame, rows: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Overwrite every field the new row carries, nulls included; unknown keys change nothing. Of
    new rows with one key the last in ``order`` counts; ``order`` is not a field."""
    fields = [c for c in rows.columns if c not in (key, order) and c in df.columns]
    new = last_of_key(rows, [key], order, fields)
    joined = df.join(new, key, "left")
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
            if c in fields
            else F.col(c)
            for c in df.columns
        ]
    )


def upsert(
    df: DataFrame, rows: DataFrame, key: Sequence[str], order: str, stamp: Column | None = None
) -> DataFrame:
    """Insert new keys and overwrite the given fields of known ones; fields the new rows do not
    carry keep their value. Of new rows with one key the last in ``order`` counts; ``order`` is not a
    field. ``stamp`` sets ``updated_at`` on touched rows. One full outer join."""
    fields = [c for c in rows.columns if c not in (*key, order)]
    new = last_of_key(rows, list(key), order, fields)
    joined = df.join(new, list(key), "full_outer")
    hit = F.col("_new").isNotNull()
    cols = []
    for c in df.columns:
        if c in key:
            cols.append(F.col(c))
        elif c == "updated_at" and stamp is not None:
            cols.append(F.when(hit, stamp).otherwise(F.col(c)).alias(c))
        elif c in fields:
            cols.append(F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols)


def dedup_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order, as an aggregate: copies collapse map-side, so a key
    that fills a third of the table costs one row per map task."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(first.alias("_r")).select(
        *key, *[F.col("_r")[c].alias(c) for c in rest]
    )


def latest_row(df: DataFrame, order: str = "date", tie: str = "id") -> DataFrame:
    """The newest row; a take-ordered of one row, not a sort."""
    return df.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(1)


def set_latest_amount(df: DataFrame, row: DataFrame) -> DataFrame:
    """Overwrite the newest row's fields with the given one-row table; insert when empty."""
    fields = [c for c in row.columns if c in df.columns and c != "id"]
    target = latest_row(df).select("id")
    new = target.select("id", F.lit(0).alias("_seq"), *[row.select(c).scalar().alias(c) for c in fields])
    empty = df.limit(1).select(F.lit(1).alias("one")).scalar().isNull()
    insert = row.where(empty)
    return append(replace_by_key(df, new, "_seq"), insert)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 25) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)
