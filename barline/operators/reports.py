"""Research reports: newest per id, and their place on the bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_reports(reports: DataFrame) -> DataFrame:
    """One row per id: the newest, undated ones last. An aggregate, so an id with a third of all
    rows collapses before the shuffle. Ties go to the larger url."""
    rest = [c for c in reports.columns if c != "id"]
    pick = F.max_by(F.struct(*rest), F.struct("ngaykn", "url"))
    best = reports.groupBy("id").agg(pick.alias("r"))
    return best.select("id", *[F.col("r")[c].alias(c) for c in rest])


def newest_first(reports: DataFrame) -> DataFrame:
    return reports.orderBy(F.col("ngaykn").desc_nulls_last(), "id")


def markers(bars: DataFrame, reports: DataFrame) -> DataFrame:
    """Dated reports placed on the bars of their symbol and day."""
    dated = reports.where(F.col("ngaykn").isNotNull()).select(
        F.col("mack").alias("symbol"), F.to_date("ngaykn").alias("date"), "id", "tenbaocao", "nguon"
    )
    return bars.select("symbol", "date", "close").join(dated, ["symbol", "date"])


def nearby(bars: DataFrame, reports: DataFrame, days: int = 3) -> DataFrame:
    """For each bar the newest report at most ``days`` whole days away, truncated toward zero.

    An equi-join on (symbol, day) instead of a range join. A report at day D and time s matches bar day B when -(days+1) < (D + s) - B < days+1, that is
    B in [D-days, D+days], plus B = D+days+1 when s > 0. Reports are cut to the newest of each
    (symbol, day, s > 0) before they are spread over those days, so a symbol or day with a third
    of all reports shrinks to two rows per day map-side.
    """
    day = F.to_date("ngaykn")
    dated = reports.where(F.col("ngaykn").isNotNull()).select(
        F.col("mack").alias("symbol"),
        day.alias("day"),
        (F.col("ngaykn") > day.cast("timestamp")).alias("inside"),
        F.struct("ngaykn", "url", "id", "tenbaocao").alias("r"),
    )
    newest = dated.groupBy("symbol", "day", "inside").agg(F.max("r").alias("r"))
    reach = F.when(F.col("inside"), days + 1).otherwise(days)
    spread = F.sequence(F.date_sub("day", days), F.date_add(F.col("day"), reach))
    per_bar = (
        newest.select("symbol", F.explode(spread).alias("date"), "r")
        .groupBy("symbol", "date")
        .agg(F.max("r").alias("r"))
    )
    return bars.select("symbol", "date", "close").join(per_bar, ["symbol", "date"]).select(
        "symbol", "date", "close",
        F.col("r.id").alias("report_id"),
        F.col("r.tenbaocao").alias("tenbaocao"),
        F.to_date("r.ngaykn").alias("report_date"),
    )
