"""Sector lookups, calendar periods, performance and rankings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import scalars as S
from barline.functions.series import along

# Period lengths of the two period menus.
CALENDAR_MONTHS = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12, "3Y": 36, "5Y": 60, "10Y": 120}
FIXED_DAYS = {"1M": 30, "3M": 90, "6M": 180, "1Y": 365, "3Y": 1095, "5Y": 1825, "10Y": 3650}


def sectors_at(sectors: DataFrame, level: int) -> DataFrame:
    return sectors.where(F.col("level") == level)


def membership(symbols: DataFrame) -> DataFrame:
    """(symbol, level, sector_id): the two parent columns as rows."""
    sides = F.array(
        F.struct(F.lit(3).alias("level"), F.col("id_sector_level_3").alias("sector_id")),
        F.struct(F.lit(4).alias("level"), F.col("id_sector_level_4").alias("sector_id")),
    )
    return symbols.withColumn("_s", F.explode(sides)).select(
        *symbols.columns, F.col("_s.level").alias("level"), F.col("_s.sector_id").alias("sector_id")
    ).where(F.col("sector_id").isNotNull())


def sector_symbols(
    symbols: DataFrame, level: int, ids: Sequence[int] | DataFrame | None = None
) -> DataFrame:
    """Symbols of the given sectors; any level other than 3 reads the level-4 parent."""
    col = "id_sector_level_3" if level == 3 else "id_sector_level_4"
    if ids is None:
        return symbols.where(F.col(col).isNotNull())
    if isinstance(ids, DataFrame):
        return symbols.join(ids.select(F.col(ids.columns[0]).alias(col)), col, "left_semi")
    return symbols.where(F.col(col).isin(list(ids)))


def sector_summary(sectors: DataFrame, symbols: DataFrame, level: int) -> DataFrame:
    """Each sector with its stocks, one row per stock; a sector without stocks keeps one row with
    a null symbol. Rows instead of a nested list: a sector may have any number of stocks."""
    col = "id_sector_level_3" if level == 3 else "id_sector_level_4"
    stocks = symbols.select(
        F.col(col).alias("id"),
        "symbol",
        F.col("name").alias("stock_name"),
        F.col("vonhoa_d").alias("stock_cap"),
    )
    return sectors_at(sectors, level).join(stocks, "id", "left")


def by_market_cap(df: DataFrame, key: str) -> DataFrame:
    """Positive market caps, largest first."""
    return df.where(F.col("vonhoa_d") > 0).orderBy(F.col("vonhoa_d").desc(), key)


def search(df: DataFrame, term: str, cols: Sequence[str]) -> DataFrame:
    return df.where(S.matches_text(term, *[F.col(c) for c in cols]))


def shown_of(df: DataFrame, cond: Column) -> DataFrame:
    """'x of y shown'."""
    return df.agg(F.count_if(cond).alias("shown"), F.count("*").alias("total"))


def period_start(period: str, as_of: date, custom: date | None = None, mode: str = "calendar") -> Column:
    """First day of a period. ``calendar`` steps back in months like a date constructor does: a
    day that does not exist runs over into the next month. ``days`` uses fixed day counts."""
    end = F.lit(as_of).cast("date")
    if period == "YTD":
        return F.trunc(end, "year")
    if period == "CUSTOM":
        return F.lit(custom).cast("date") if custom else F.date_sub(end, 365)
    if mode == "days":
        return F.date_sub(end, FIXED_DAYS[period])
    months = CALENDAR_MONTHS[period]
    first = F.add_months(F.trunc(end, "month"), -months)
    return F.date_add(first, F.dayofmonth(end) - 1)


def period_filter(
    df: DataFrame,
    period: str,
    as_of: date,
    custom: date | None = None,
    mode: str = "calendar",
    by: str | None = None,
    order: str = "date",
    days: DataFrame | None = None,
) -> DataFrame:
    """Rows from the period's start on. If the start lies after all data, or before the first
    day, everything is returned; ALL does not filter. ``by`` applies the rule per key.

    Without ``by`` the first and last day are looked up at once, in ``days`` if given (the raw
    table with the same days), so that the result has a plain date filter, which reaches the scan,
    or none.
    """
    if period == "ALL":
        return df
    start = period_start(period, as_of, custom, mode)
    d = F.col(order)
    if by is None:
        ends = (df if days is None else days).agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
        found = ends.select("lo", "hi", start.alias("start")).first()
        if found.lo is None or not found.lo <= found.start <= found.hi:
            return df
        return df.where(d >= F.lit(found.start))
    ends = df.groupBy(by).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    keep = (d >= start) | (start > F.col("_hi")) | (start < F.col("_lo"))
    return df.join(ends, by).where(keep).drop("_lo", "_hi")


def period_performance(df: DataFrame, by: Sequence[str], order: str = "date") -> DataFrame:
    """(last - first)/first·100 per key; NULL where the first value is 0 or missing."""
    ends = df.groupBy(*by).agg(
        F.min_by("close", order).alias("first"), F.max_by("close", order).alias("last")
    )
    perf = S.ratio(F.col("last") - F.col("first"), F.col("first")) * 100.0
    return ends.withColumn("performance", perf)


def normalized_returns(
    df: DataFrame, by: str, digits: int | None = None, order: str = "date"
) -> DataFrame:
    """Percent return since the key's first value, 0 where that is 0 or missing."""
    df = df.withColumn("_f", F.first("close").over(along(by, order)))
    value = F.coalesce((S.ratio(F.col("close"), F.col("_f")) - 1.0) * 100.0, F.lit(0.0))
    return df.withColumn("return_pct", F.round(value, digits) if digits is not None else value).drop("_f")


def top_n(perf: DataFrame, n: int, key: str, clamp: tuple[int, int] | None = None) -> DataFrame:
    """The n best performers; ties by name. A take-ordered, not a sort."""
    if clamp:
        n = max(clamp[0], min(clamp[1], n))
    known = perf.where(F.col("performance").isNotNull())
    return known.orderBy(F.col("performance").desc(), key).limit(n)


def ranked(perf: DataFrame, key: str) -> DataFrame:
    """All keys by performance, missing counted as 0."""
    return perf.orderBy(F.coalesce(F.col("performance"), F.lit(0.0)).desc(), key)


def compare(bars: DataFrame, base: str, others: Sequence[str] | None = None) -> DataFrame:
    """Normalised returns of symbols on the base symbol's dates, matched by date (the positions
    of two series need not line up)."""
    days = bars.where(F.col("symbol") == base).select("date")
    df = bars if others is None else bars.where(F.col("symbol").isin([base, *others]))
    return normalized_returns(df.join(days, "date", "left_semi"), "symbol")
