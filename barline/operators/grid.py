"""Dense date grid, packing and reshaping of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import scalars as S
from barline.functions.series import KEY, ORDER, along
from barline.schemas import PRICE_FIELDS


def calendar(bars: DataFrame, order: str = ORDER) -> DataFrame:
    """One row holding the sorted array of all days seen. A DATE column has at most 36,525
    distinct values per century, so the array is bounded by the calendar, not by the data. Days are
    made distinct on their own first: the last task gets each day once, not once per map task."""
    return bars.select(order).distinct().agg(F.sort_array(F.collect_list(order)).alias("days"))


def densify(
    bars: DataFrame,
    fields: Sequence[str] = PRICE_FIELDS,
    by: str = KEY,
    order: str = ORDER,
    days: DataFrame | None = None,
    filled: bool = False,
) -> DataFrame:
    """Every key on every day seen anywhere; missing cells take the next known value, trailing
    ones the last known (so the fill looks ahead). Adds ``rn``, the day's position in the grid.

    No key × date cross product is joined: each bar is expanded over the days since the previous
    bar, which is exactly the stretch a backward fill copies it to; the last bar also covers the
    days after it. Nulls inside existing bars are filled on the sparse rows first; ``filled``
    says there are none and saves that sort.
    """
    days = calendar(bars, order) if days is None else days
    spots = days.select(F.posexplode("days").alias("_i", order))
    df = bars.join(F.broadcast(spots), order)  # bounded by the calendar
    if not filled:
        back = Window.partitionBy(by).orderBy(F.col("_i").desc()).rowsBetween(
            Window.unboundedPreceding, 0
        )
        ahead = along(by, "_i").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"_b_{c}": F.last(c, ignorenulls=True).over(back) for c in fields})
        df = df.withColumns(
            {c: F.coalesce(f"_b_{c}", F.last(c, ignorenulls=True).over(ahead)) for c in fields}
        ).drop(*[f"_b_{c}" for c in fields])
    size = days.select(F.size("days")).scalar()
    df = df.withColumn("_lo", F.coalesce(F.lag("_i").over(along(by, "_i")) + 1, F.lit(0))).withColumn(
        "_nx", F.lead("_i").over(along(by, "_i"))
    )
    hi = F.when(F.col("_nx").isNull(), size - 1).otherwise(F.col("_i"))
    df = df.withColumn("rn", F.explode(F.sequence("_lo", hi)))
    all_days = days.scalar()
    return df.select(by, F.element_at(all_days, F.col("rn") + 1).alias(order), "rn", *fields)


def pack_series(df: DataFrame, fields: Sequence[str], by: str = KEY, order: str = ORDER) -> DataFrame:
    """Struct-of-arrays pages: per key and calendar year, ISO days and one array per field, all
    in date order. A page holds at most 366 points, so no key's whole history sits in one row;
    pages of a key concatenate by year."""
    point = F.struct(F.col(order), *[F.col(c) for c in fields])
    packed = (
        df.groupBy(by, F.year(order).alias("year"))
        .agg(F.array_sort(F.collect_list(point)).alias("p"))
    )
    cols = [F.transform("p", lambda x: S.iso_day(x[order])).alias("timestamps")]
    cols += [F.col("p")[c].alias(c) for c in fields]
    return packed.select(by, "year", *cols)


def pivot_close(
    df: DataFrame, keys: Sequence[object], by: str = KEY, value: str = "close", order: str = ORDER
) -> DataFrame:
    """Wide presentation for a named list of keys: one row per date, one column per key. The
    list is given, so no job is spent on finding it and the width is the caller's choice."""
    return (
        df.where(F.col(by).isin(list(keys)))
        .groupBy(order)
        .pivot(by, list(keys))
        .agg(F.first(value, ignorenulls=True))
    )


def with_level(df: DataFrame, **levels: float) -> DataFrame:
    """Constant guide lines next to each point."""
    return df.withColumns({name: F.lit(float(v)) for name, v in levels.items()})


def drop_empty_points(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(S.is_point(F.col(c)))
    return df


def candle_facts(bars: DataFrame, by: str = KEY, order: str = ORDER) -> DataFrame:
    """Per bar: up flag, percent change against the previous close (its own open on the first
    bar) as number and as signed text, UNIX seconds and a dd/MM/yyyy label."""
    prev = F.coalesce(F.lag("close").over(along(by, order)), F.col("open"))
    change = S.ratio(F.col("close") - F.col("_p"), F.col("_p")) * 100.0
    return (
        bars.withColumn("_p", prev)
        .withColumn("change", change)
        .withColumn("change_text", S.signed_percent(F.col("change")))
        .withColumn("up", F.col("close") >= F.col("open"))
        .withColumn("legend_up", F.col("close") >= F.col("_p"))
        .withColumn("time", S.epoch_seconds(F.col(order)))
        .withColumn("label", S.day_label(F.col(order)))
        .drop("_p")
    )


def combine(df: DataFrame, out: str, cond: Column) -> DataFrame:
    return df.withColumn(out, S.safe(cond))
