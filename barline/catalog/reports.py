"""Research reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.registry import query, tidy
from barline.catalog.sql import BARS, REPORTS, cols, with_
from barline.functions import scalars as S
from barline.operators import reports
from barline.sources import derived
from barline.sources import tables as scans


@query(
    "latest_reports",
    with_(REPORTS) + " SELECT id, mack, tenbaocao, url, nguon, ngaykn FROM latest",
)
def latest_reports(spark, sf):
    df = reports.latest_reports(derived.reports(spark, sf))
    return df.select("id", "mack", "tenbaocao", "url", "nguon", "ngaykn")


@query(
    "reports_newest_first",
    with_(REPORTS) + " SELECT id, mack, ngaykn FROM latest ORDER BY ngaykn DESC NULLS LAST, id",
)
def reports_newest_first(spark, sf):
    df = reports.latest_reports(derived.reports(spark, sf))
    return reports.newest_first(df.select("id", "mack", "ngaykn"))


@query(
    "symbol_reports",
    with_(REPORTS)
    + """ SELECT id, url, ngaykn FROM (SELECT *, row_number() OVER (PARTITION BY id
      ORDER BY ngaykn DESC NULLS LAST, url DESC) AS k FROM reports WHERE mack = 'S7') WHERE k = 1""",
)
def symbol_reports(spark, sf):
    """The one-symbol lookup, given in lower case."""
    own = scans.reports_for(derived.reports(spark, sf), "s7")
    return reports.latest_reports(own).select("id", "url", "ngaykn")


@query(
    "report_markers",
    with_(BARS, REPORTS)
    + f""" SELECT b.symbol, b.date, l.id, l.tenbaocao, {cols(close="b.close")}
    FROM bars b JOIN latest l ON l.mack = b.symbol AND CAST(l.ngaykn AS DATE) = b.date""",
)
def report_markers(spark, sf):
    df = reports.markers(derived.bars(spark, sf), reports.latest_reports(derived.reports(spark, sf)))
    return tidy(df, "symbol", "date", "id", "tenbaocao", "close")


@query(
    "nearby_reports",
    with_(BARS, REPORTS)
    + """ SELECT symbol, date, report_id, report_date FROM (
      SELECT b.symbol, b.date, l.id AS report_id, CAST(l.ngaykn AS DATE) AS report_date,
        row_number() OVER (PARTITION BY b.symbol, b.date ORDER BY l.ngaykn DESC, l.url DESC) AS k
      FROM bars b JOIN latest l ON l.mack = b.symbol
       AND abs(date_diff('microsecond', CAST(b.date AS TIMESTAMP), l.ngaykn)) < 4 * 86400000000)
    WHERE k = 1""",
)
def nearby_reports(spark, sf):
    df = reports.nearby(derived.bars(spark, sf), reports.latest_reports(derived.reports(spark, sf)), 3)
    return df.select("symbol", "date", "report_id", "report_date")


@query(
    "report_labels",
    with_(REPORTS)
    + """ SELECT url, coalesce(strftime(ngaykn, '%d/%m/%Y'), '-') AS label,
      CAST(epoch(CAST(ngaykn AS DATE)) AS BIGINT) AS day_seconds FROM reports""",
)
def report_labels(spark, sf):
    day = F.to_date("ngaykn")
    return derived.reports(spark, sf).select(
        "url", S.day_label(day).alias("label"), S.epoch_seconds(day).alias("day_seconds")
    )
