"""Sectors: import, lookups, periods, performance and rankings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barline.catalog.registry import query, rsql, tidy
from barline.catalog.sql import BARS, SECTOR_INDEX, SECTORS, cols, with_
from barline.operators import sectors, tables
from barline.sources import derived, sector_import
from barline.sources import tables as scans

AS_OF = date(2001, 6, 30)


@query(
    "sector_series",
    with_(SECTOR_INDEX)
    + f""" SELECT sector_id, sector_name, date, {cols(close="close")} FROM sector_index
    WHERE sector_type = 3""",
)
def sector_series(spark, sf):
    df = scans.sector_series(derived.sector_index(spark, sf), 3)
    return tidy(df, "sector_id", "sector_name", "date", "close")


@query(
    "distinct_sectors",
    with_(SECTOR_INDEX) + " SELECT DISTINCT sector_type, sector_id, sector_name FROM sector_index",
)
def distinct_sectors(spark, sf):
    return derived.sector_index(spark, sf).select("sector_type", "sector_id", "sector_name").distinct()


@query(
    "imported_sectors",
    f"""SELECT n_nationkey AS id, 4 AS level, CAST(n_regionkey AS VARCHAR) AS type, n_name AS name,
      {cols(pe_d="n", vonhoa_d="cap")}, CAST(NULL AS DOUBLE) AS smg
    FROM nation JOIN (SELECT s_nationkey, sum(s_acctbal) AS cap, count(*) AS n
      FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey""",
)
def imported_sectors(spark, sf):
    df = sector_import.flatten_payload(derived.sector_payload(spark, sf), 4)
    return tidy(df, "id", "level", "type", "name", "pe_d", "vonhoa_d", "smg")


@query(
    "upserted_sectors",
    with_(SECTORS)
    + f""", n AS (SELECT n_nationkey AS id, CAST(n_regionkey AS VARCHAR) AS type, sum(s_acctbal) AS cap,
        count(*) AS pe FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)
    SELECT s.id, s.level, CASE WHEN n.id IS NULL THEN s.type ELSE n.type END AS type, s.name,
      {cols(vonhoa_d="CASE WHEN n.id IS NULL THEN s.vonhoa_d ELSE n.cap END")}
    FROM sector s LEFT JOIN n ON n.id = s.id AND s.level = 4""",
)
def upserted_sectors(spark, sf):
    new = sector_import.flatten_payload(derived.sector_payload(spark, sf), 4)
    df = tables.upsert(
        derived.sectors(spark, sf),
        new.select("id", "level", "type", "name", "vonhoa_d", "entry_no"),
        ["id", "level"],
        "entry_no",
    )
    return tidy(df, "id", "level", "type", "name", "vonhoa_d")


@query(
    "upserted_symbols",
    with_(SECTORS)
    + f""" SELECT symbol, name || CASE WHEN vonhoa_d > 0 THEN ' JSC' ELSE '' END AS name,
      {cols(vonhoa_d="vonhoa_d")} FROM stock_symbol
    UNION ALL SELECT 'N' || n_nationkey, n_name, NULL FROM nation""",
)
def upserted_symbols(spark, sf):
    old = derived.stock_symbols(spark, sf)
    known = old.where(F.col("vonhoa_d") > 0).select(
        "symbol", F.concat("name", F.lit(" JSC")).alias("name")
    )
    new = derived.table(spark, sf, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("symbol"),
        F.col("n_name").alias("name"),
    )
    last = known.unionByName(new).withColumn("seq", F.lit(2))
    first = last.withColumns({"seq": F.lit(1), "name": F.lit("overwritten")})
    df = tables.upsert(old, last.unionByName(first), ["symbol"], "seq")
    return tidy(df, "symbol", "name", "vonhoa_d")


@query(
    "sectors_at_level",
    with_(SECTORS) + f" SELECT id, name, type, {cols(vonhoa_d='vonhoa_d')} FROM sector WHERE level = 4",
)
def sectors_at_level(spark, sf):
    return tidy(sectors.sectors_at(derived.sectors(spark, sf), 4), "id", "name", "type", "vonhoa_d")


@query(
    "sector_lookup",
    with_(SECTORS)
    + """ SELECT id, level, name FROM sector
    WHERE (id, level) IN (SELECT id_sector_level_4, 4 FROM stock_symbol WHERE vonhoa_d > 5000)""",
)
def sector_lookup(spark, sf):
    rich = derived.stock_symbols(spark, sf).where(F.col("vonhoa_d") > 5000)
    keys = rich.select(F.col("id_sector_level_4").alias("id"), F.lit(4).alias("level")).distinct()
    return tables.lookup(derived.sectors(spark, sf), keys).select("id", "level", "name")


@query(
    "sector_membership",
    with_(SECTORS)
    + """ SELECT symbol, 3 AS level, id_sector_level_3 AS sector_id FROM stock_symbol
    UNION ALL SELECT symbol, 4, id_sector_level_4 FROM stock_symbol""",
)
def sector_membership(spark, sf):
    df = sectors.membership(derived.stock_symbols(spark, sf))
    return df.select("symbol", "level", "sector_id")


@query(
    "sector_symbols",
    with_(SECTORS)
    + """ SELECT symbol, id_sector_level_3 AS sector_id FROM stock_symbol
    WHERE id_sector_level_3 IN (SELECT id FROM sector WHERE level = 3 AND vonhoa_d > 0)""",
)
def sector_symbols(spark, sf):
    wanted = sectors.sectors_at(derived.sectors(spark, sf), 3).where(F.col("vonhoa_d") > 0)
    df = sectors.sector_symbols(derived.stock_symbols(spark, sf), 3, wanted.select("id"))
    return df.select("symbol", F.col("id_sector_level_3").alias("sector_id"))


@query(
    "sector_symbols_level_4",
    with_(SECTORS)
    + """ SELECT symbol, id_sector_level_4 AS sector_id FROM stock_symbol
    WHERE id_sector_level_4 IN (SELECT id FROM sector WHERE level = 4 AND vonhoa_d > 0)""",
)
def sector_symbols_level_4(spark, sf):
    wanted = sectors.sectors_at(derived.sectors(spark, sf), 4).where(F.col("vonhoa_d") > 0)
    df = sectors.sector_symbols(derived.stock_symbols(spark, sf), 4, wanted.select("id"))
    return df.select("symbol", F.col("id_sector_level_4").alias("sector_id"))


@query(
    "sector_summary",
    with_(SECTORS)
    + f""" SELECT c.id, c.name, s.symbol, s.name AS stock_name, {cols(stock_cap="s.vonhoa_d")}
    FROM sector c LEFT JOIN stock_symbol s ON s.id_sector_level_4 = c.id WHERE c.level = 4""",
)
def sector_summary(spark, sf):
    df = sectors.sector_summary(derived.sectors(spark, sf), derived.stock_symbols(spark, sf), 4)
    return tidy(df, "id", "name", "symbol", "stock_name", "stock_cap")


@query(
    "stocks_by_market_cap",
    with_(SECTORS)
    + f""" SELECT symbol, {cols(vonhoa_d="vonhoa_d")} FROM stock_symbol WHERE vonhoa_d > 0
    ORDER BY stock_symbol.vonhoa_d DESC, symbol""",
)
def stocks_by_market_cap(spark, sf):
    return tidy(sectors.by_market_cap(derived.stock_symbols(spark, sf), "symbol"), "symbol", "vonhoa_d")


@query(
    "sectors_by_market_cap",
    with_(SECTORS)
    + f""" SELECT level, name, {cols(vonhoa_d="vonhoa_d")} FROM sector WHERE vonhoa_d > 0
    ORDER BY sector.vonhoa_d DESC, name""",
)
def sectors_by_market_cap(spark, sf):
    return tidy(sectors.by_market_cap(derived.sectors(spark, sf), "name"), "level", "name", "vonhoa_d")


_PLAIN = "replace(strip_accents(lower(text)), 'đ', 'd')"


@query(
    "accent_search",
    f"""SELECT doc_id, source FROM documents
    WHERE contains(lower(text), 'ños') OR contains({_PLAIN}, 'nos')
       OR contains(lower(source), 'ños') OR contains(replace(strip_accents(lower(source)), 'đ', 'd'), 'nos')""",
)
def accent_search(spark, sf):
    docs = derived.table(spark, sf, "documents")
    return sectors.search(docs, "Ños", ["text", "source"]).select("doc_id", "source")


@query(
    "shown_of_total",
    with_(SECTORS)
    + """ SELECT count(*) FILTER (WHERE contains(lower(name), 'nation_1')) AS shown, count(*) AS total
    FROM sector""",
)
def shown_of_total(spark, sf):
    cond = F.lower("name").contains("nation_1")
    return sectors.shown_of(derived.sectors(spark, sf), cond)


def _period(start: str, src: str = "sector_index") -> str:
    """Rows from the period's start, or all if it misses the data."""
    return f"""ends AS (SELECT min(date) AS lo, max(date) AS hi FROM {src}),
    per AS MATERIALIZED (SELECT s.* FROM {src} s, ends
      WHERE date >= {start} OR {start} > hi OR {start} < lo)"""


_PERF = """
perf AS MATERIALIZED (SELECT sector_name, (arg_max(close, date) - arg_min(close, date))
  / nullif(arg_min(close, date), 0) * 100 AS performance FROM per GROUP BY sector_name)"""

_LEVEL4 = "lv AS MATERIALIZED (SELECT * FROM sector_index WHERE sector_type = 4)"


def _days(spark, sf):
    """The raw days behind the bars and the sector series."""
    return derived.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))


def _level4(spark, sf):
    return scans.sector_series(derived.sector_index(spark, sf), 4)


@query(
    "period_six_months",
    with_(SECTOR_INDEX, _LEVEL4, _period("DATE '2000-12-30'", "lv"))
    + f" SELECT sector_name, date, {cols(close='close')} FROM per",
)
def period_six_months(spark, sf):
    df = sectors.period_filter(_level4(spark, sf), "6M", AS_OF, days=_days(spark, sf))
    return tidy(df, "sector_name", "date", "close")


@query(
    "period_year_to_date",
    with_(BARS, _period("DATE '2001-01-01'", "bars"))
    + f" SELECT symbol, date, {cols(close='close')} FROM per",
)
def period_year_to_date(spark, sf):
    df = sectors.period_filter(derived.bars(spark, sf), "YTD", AS_OF, days=_days(spark, sf))
    return tidy(df, "symbol", "date", "close")


@query(
    "period_before_data",
    with_(BARS, _period("DATE '1991-06-30'", "bars"))
    + f" SELECT symbol, date, {cols(close='close')} FROM per",
)
def period_before_data(spark, sf):
    """Ten years back reaches before the first bar: everything is returned."""
    df = sectors.period_filter(derived.bars(spark, sf), "10Y", AS_OF, days=_days(spark, sf))
    return tidy(df, "symbol", "date", "close")


@query(
    "period_per_symbol",
    with_(BARS)
    + f""", ends AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM bars GROUP BY symbol)
    SELECT symbol, date, {cols(close="close")} FROM bars JOIN ends USING (symbol)
    WHERE date >= DATE '2001-04-01' OR DATE '2001-04-01' > hi OR DATE '2001-04-01' < lo""",
)
def period_per_symbol(spark, sf):
    df = sectors.period_filter(derived.bars(spark, sf), "3M", AS_OF, mode="days", by="symbol")
    return tidy(df, "symbol", "date", "close")


@query(
    "period_custom",
    with_(SECTOR_INDEX, _period("DATE '1999-09-09'"))
    + f" SELECT sector_type, sector_name, date, {cols(close='close')} FROM per",
)
def period_custom(spark, sf):
    df = sectors.period_filter(
        derived.sector_index(spark, sf), "CUSTOM", AS_OF, custom=date(1999, 9, 9), days=_days(spark, sf)
    )
    return tidy(df, "sector_type", "sector_name", "date", "close")


@query(
    "sector_performance",
    with_(SECTOR_INDEX, _LEVEL4, _period("DATE '1998-06-30'", "lv"), _PERF)
    + f" SELECT sector_name, {cols(performance='performance')} FROM perf",
)
def sector_performance(spark, sf):
    df = sectors.period_filter(_level4(spark, sf), "3Y", AS_OF, days=_days(spark, sf))
    return tidy(sectors.period_performance(df, ["sector_name"]), "sector_name", "performance")


@query(
    "top_sectors",
    with_(SECTOR_INDEX, _LEVEL4, _period("DATE '2000-12-30'", "lv"), _PERF)
    + f""" SELECT sector_name, {cols(performance="performance")} FROM perf WHERE performance IS NOT NULL
    ORDER BY perf.performance DESC, sector_name LIMIT 10""",
)
def top_sectors(spark, sf):
    df = sectors.period_filter(_level4(spark, sf), "6M", AS_OF, days=_days(spark, sf))
    perf = sectors.period_performance(df, ["sector_name"])
    top = sectors.top_n(perf, 10, "sector_name", clamp=(1, 20))
    return tidy(top, "sector_name", "performance")


@query(
    "ranked_sectors",
    with_(SECTOR_INDEX, _LEVEL4, _period("DATE '2000-06-30'", "lv"), _PERF)
    + f""" SELECT sector_name, {cols(performance="performance")} FROM perf
    ORDER BY coalesce(perf.performance, 0) DESC, sector_name""",
)
def ranked_sectors(spark, sf):
    df = sectors.period_filter(_level4(spark, sf), "1Y", AS_OF, days=_days(spark, sf))
    perf = sectors.period_performance(df, ["sector_name"])
    return tidy(sectors.ranked(perf, "sector_name"), "sector_name", "performance")


@query(
    "top_symbols",
    with_(BARS, _period("DATE '2000-06-30'", "bars"))
    + f""", perf AS (SELECT symbol, (arg_max(close, date) - arg_min(close, date))
      / nullif(arg_min(close, date), 0) * 100 AS performance FROM per GROUP BY symbol)
    SELECT symbol, {cols(performance="performance")} FROM perf WHERE performance IS NOT NULL
    ORDER BY perf.performance DESC, symbol LIMIT 10""",
)
def top_symbols(spark, sf):
    df = sectors.period_filter(derived.bars(spark, sf), "1Y", AS_OF, mode="days", days=_days(spark, sf))
    perf = sectors.period_performance(df, ["symbol"])
    return tidy(sectors.top_n(perf, 10, "symbol"), "symbol", "performance")


@query(
    "sector_returns_chart",
    with_(SECTOR_INDEX, _LEVEL4, _period("DATE '2000-12-30'", "lv"))
    + f""" SELECT sector_name, date, {rsql('''(close / first_value(close) OVER (
      PARTITION BY sector_name ORDER BY date) - 1) * 100''', 3)} AS return_pct FROM per""",
)
def sector_returns_chart(spark, sf):
    df = sectors.period_filter(_level4(spark, sf), "6M", AS_OF, days=_days(spark, sf))
    df = sectors.normalized_returns(df, "sector_name")
    return tidy(df, "sector_name", "date", "return_pct", digits=3)


@query(
    "symbol_comparison",
    with_(BARS)
    + f""", base AS (SELECT date FROM bars WHERE symbol = 'S0')
    SELECT symbol, date, {cols(return_pct='''(close / first_value(close) OVER (
      PARTITION BY symbol ORDER BY date) - 1) * 100''')}
    FROM bars WHERE date IN (FROM base)""",
)
def symbol_comparison(spark, sf):
    """All symbols against one base symbol's dates."""
    return tidy(sectors.compare(derived.bars(spark, sf), "S0"), "symbol", "date", "return_pct")
