"""Scans, latest values, grid, packing and per-bar projections."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from barline.catalog.registry import query, r, rsql, tidy
from barline.catalog.sql import B, BARS, DENSE, cols, with_
from barline.functions import scalars as S
from barline.functions.series import with_rn
from barline.operators import grid, portfolio, sectors
from barline.operators import indicators as I
from barline.session import checkpoint_dir
from barline.sources import derived, tables

AS_OF = date(2001, 6, 30)
OHLCV = "open high low close volume".split()


@query(
    "load_bars",
    with_(BARS)
    + f""" SELECT symbol, date, {cols(close="close", volume="volume")} FROM bars
    WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
)
def load_bars(spark, sf):
    df = tables.filter_bars(
        derived.bars(spark, sf),
        start=date(1996, 1, 1),
        end=date(2000, 12, 31),
        columns=["symbol", "date", "close", "volume"],
    )
    return tidy(df)


@query(
    "watchlist_bars",
    with_(BARS)
    + f""" SELECT symbol, date, {cols(close="close")} FROM bars
    WHERE symbol IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0)""",
)
def watchlist_bars(spark, sf):
    stocks = derived.stock_symbols(spark, sf)
    watch = stocks.where(F.col("vonhoa_d") > 0).select("symbol")
    df = tables.filter_bars(derived.bars(spark, sf), watchlist=watch)
    return tidy(df, "symbol", "date", "close")


@query(
    "sorted_bars",
    with_(BARS) + f" SELECT symbol, date, {cols(**{c: c for c in OHLCV})} FROM bars ORDER BY symbol, date",
)
def sorted_bars(spark, sf):
    return tables.sorted_bars(tidy(derived.bars(spark, sf)))


@query(
    "recent_bars",
    with_(BARS)
    + f""" SELECT symbol, date, {cols(close="close")} FROM bars
    WHERE date BETWEEN DATE '2001-06-30' - 365 AND DATE '2001-06-30'""",
)
def recent_bars(spark, sf):
    return tidy(tables.last_days(derived.bars(spark, sf), AS_OF, 365), "symbol", "date", "close")


@query(
    "latest_price",
    with_(BARS)
    + f""" SELECT symbol, max(date) AS price_date, {cols(price="arg_max(close, date)")} FROM bars
    WHERE date BETWEEN DATE '2001-06-27' AND DATE '2001-06-30' GROUP BY symbol""",
)
def latest_price(spark, sf):
    return tidy(portfolio.latest_price(derived.bars(spark, sf), AS_OF, 3))


@query(
    "dense_grid",
    with_(DENSE) + f" SELECT symbol, date, rn, {cols(**{c: c for c in OHLCV})} FROM dense",
)
def dense_grid(spark, sf):
    return tidy(grid.densify(derived.bars_by_symbol(spark, sf, derived.DENSE_PART)))


@query(
    "distinct_dates",
    with_(BARS) + " SELECT DISTINCT date FROM bars",
)
def distinct_dates(spark, sf):
    return grid.calendar(derived.bars(spark, sf)).select(F.explode("days").alias("date"))


@query(
    "bar_index",
    with_(DENSE)
    + """ SELECT b.symbol, b.date, c.rn AS idx, CAST(row_number() OVER (
        PARTITION BY b.symbol ORDER BY b.date) - 1 AS INTEGER) AS rn
    FROM bars b JOIN cal c ON c.date = b.date""",
)
def bar_index(spark, sf):
    """Position in the grid and in the symbol's own series."""
    bars = derived.bars(spark, sf)
    spots = grid.calendar(bars).select(F.posexplode("days").alias("idx", "date"))
    df = with_rn(bars.select("symbol", "date"))
    return df.join(F.broadcast(spots), "date").select("symbol", "date", "idx", "rn")


@query(
    "date_bounds",
    with_(BARS) + " SELECT min(date) AS first_date, max(date) AS last_date FROM bars",
)
def date_bounds(spark, sf):
    from barline.plans.features import date_bounds as bounds

    return bounds(derived.bars(spark, sf))


@query(
    "packed_series",
    with_(BARS)
    + """ SELECT symbol, CAST(year(date) AS INTEGER) AS year,
      string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY date) AS timestamps,
      string_agg(CAST(CAST(round(close * 10000.0::DOUBLE) AS BIGINT) AS VARCHAR), ',' ORDER BY date)
        AS closes,
      string_agg(CAST(CAST(volume AS BIGINT) AS VARCHAR), ',' ORDER BY date) AS volumes
    FROM bars GROUP BY symbol, year(date)""",
)
def packed_series(spark, sf):
    packed = grid.pack_series(derived.bars(spark, sf), ["close", "volume"])
    whole = F.transform("close", lambda x: F.round(x * 10000.0).cast("bigint").cast("string"))
    vols = F.transform("volume", lambda x: x.cast("bigint").cast("string"))
    return packed.select(
        "symbol",
        "year",
        F.array_join("timestamps", ",").alias("timestamps"),
        F.array_join(whole, ",").alias("closes"),
        F.array_join(vols, ",").alias("volumes"),
    )


@query(
    "pivoted_closes",
    with_(BARS)
    + f""", cal AS (SELECT DISTINCT date FROM bars)
    SELECT date, {", ".join(f"{rsql(f'max(CASE WHEN n_name = {chr(39)}NATION_{i}{chr(39)} THEN x END)')} AS NATION_{i}" for i in range(25))}
    FROM (SELECT n_name, date, sum(close * volume) / sum(volume) AS x
          FROM bars JOIN supplier ON symbol = 'S' || s_suppkey JOIN nation ON s_nationkey = n_nationkey
          GROUP BY n_name, date)
    GROUP BY date""",
)
def pivoted_closes(spark, sf):
    """One column per level-4 sector; the names are the sector dimension's, which is as wide as the
    result is meant to be."""
    series = tables.sector_series(derived.sector_index(spark, sf), 4)
    names = sorted(row.n_name for row in derived.table(spark, sf, "nation").select("n_name").distinct().collect())
    return tidy(grid.pivot_close(series, names, by="sector_name"))


@query(
    "candle_facts",
    with_(B)
    + f""", f AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), open) AS p FROM b)
    SELECT symbol, date, close >= open AS up, close >= p AS legend_up,
      {cols(change="(close - p) / p * 100")},
      CAST(epoch(date) AS BIGINT) AS time, strftime(date, '%d/%m/%Y') AS label
    FROM f""",
)
def candle_facts(spark, sf):
    df = grid.candle_facts(derived.bars(spark, sf))
    return tidy(df, "symbol", "date", "up", "legend_up", "change", "time", "label")


@query(
    "change_text",
    with_(B)
    + """, f AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), open) AS p FROM b),
    c AS (SELECT symbol, date, (close - p) / p * 100 AS x FROM f)
    SELECT symbol, date, CASE WHEN x >= 0 THEN '+' ELSE '-' END
      || printf('%.2f', CAST(abs(round(x, 2)) AS DOUBLE)) || '%' AS change_text FROM c""",
)
def change_text(spark, sf):
    df = grid.candle_facts(derived.bars(spark, sf))
    return df.select("symbol", "date", "change_text")


@query(
    "guide_lines",
    with_(B)
    + """ SELECT symbol, date, 70.0::DOUBLE AS upper, 30.0::DOUBLE AS lower, 0.0::DOUBLE AS zero
    FROM b WHERE rn >= 19""",
)
def guide_lines(spark, sf):
    points = grid.drop_empty_points(I.sma(derived.bars(spark, sf), 20), "sma")
    return grid.with_level(points.select("symbol", "date"), upper=70, lower=30, zero=0)


@query(
    "non_empty_points",
    with_(B)
    + f""", m AS (SELECT symbol, date, CASE WHEN rn >= 49 THEN avg(close) OVER (
        PARTITION BY symbol ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS sma FROM b)
    SELECT symbol, date, {cols(sma="sma")} FROM m WHERE sma IS NOT NULL""",
)
def non_empty_points(spark, sf):
    df = grid.drop_empty_points(I.sma(derived.bars(spark, sf), 50), "sma")
    return tidy(df, "symbol", "date", "sma")


@query(
    "nan_to_null",
    f"""SELECT l_orderkey, l_linenumber, l_partkey,
      {cols(x="CASE WHEN l_discount > 0.01 AND l_tax > 0.0 THEN l_tax / l_discount END")}
    FROM lineitem""",
)
def nan_to_null(spark, sf):
    li = derived.table(spark, sf, "lineitem")
    raw = F.when((F.col("l_discount") > 0.01) & (F.col("l_tax") > 0.0), F.col("l_tax") / F.col("l_discount"))
    raw = F.coalesce(raw, F.lit(float("nan")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", r(S.nan_to_null(raw)).alias("x"))


@query(
    "simple_return",
    with_(B)
    + f""" SELECT symbol, date,
      {cols(ret="close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1")} FROM b""",
)
def simple_return(spark, sf):
    return tidy(I.simple_return(derived.bars(spark, sf)), "symbol", "date", "ret")


@query(
    "normalized_return",
    with_(B)
    + f""" SELECT symbol, date, {cols(return_pct='''(close / first_value(close) OVER (
        PARTITION BY symbol ORDER BY rn) - 1) * 100''')} FROM b""",
)
def normalized_return(spark, sf):
    df = sectors.normalized_returns(derived.bars(spark, sf), "symbol")
    return tidy(df, "symbol", "date", "return_pct")


@query(
    "log_distance",
    with_(B)
    + f""", m AS (SELECT symbol, date, volume, CASE WHEN rn >= 9 THEN avg(volume) OVER (
        PARTITION BY symbol ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS ma FROM b)
    SELECT symbol, date, {cols(x="ln(1 + (volume - ma) / ma)")} FROM m""",
)
def log_distance(spark, sf):
    df = I.sma(derived.bars(spark, sf), 10, "volume", "ma")
    x = S.log_distance(F.col("volume"), F.col("ma"))
    return df.select("symbol", "date", r(x).alias("x"))


@query(
    "unique_bars",
    with_(BARS) + f" SELECT symbol, date, {cols(**{c: c for c in OHLCV})} FROM bars",
)
def unique_bars(spark, sf):
    """A feed that repeats every bar collapses to the bars."""
    bars = derived.bars(spark, sf)
    return tidy(tables.unique_bars(bars.unionByName(bars)))


@query(
    "clipped_moves",
    with_(B)
    + f""" SELECT symbol, date, {cols(clipped="greatest(close - open, 0)",
      filled="coalesce(nullif(close - open, 0), 1e-9)")} FROM b""",
)
def clipped_moves(spark, sf):
    """Lower clip, zero replaced by NULL and NULL by a constant."""
    d = F.col("close") - F.col("open")
    return derived.bars(spark, sf).select(
        "symbol",
        "date",
        r(S.clip_low(d)).alias("clipped"),
        r(F.coalesce(S.zero_to_null(d), F.lit(1e-9))).alias("filled"),
    )


# --- written and read again ------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "written_bars",
    with_(BARS)
    + f""" SELECT symbol, date, {cols(**{c: c for c in OHLCV})} FROM bars
    WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""",
)
def written_bars(spark, sf):
    """Bars through the sink, in year folders, and a date range of them back."""
    path = _folder(spark, "bars")
    tables.write_bars(derived.bars(spark, sf), path)
    return tidy(
        tables.load_bars(spark, path, start=date(1997, 1, 1), end=date(1999, 12, 31)),
        "symbol", "date", *OHLCV,
    )


@query(
    "stored_features",
    with_(B)
    + f""", m AS (SELECT symbol, date, CASE WHEN rn >= 19 THEN avg(close) OVER (
        PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sma FROM b)
    SELECT symbol, date, {cols(sma="sma")} FROM m
    WHERE symbol IN ('S1', 'S3') AND date >= DATE '1996-01-01'""",
)
def stored_features(spark, sf):
    """A feature table through the sink, and two symbols of it back."""
    path = _folder(spark, "features")
    tables.write_table(I.sma(derived.bars(spark, sf), 20).select("symbol", "date", "sma"), path)
    return tidy(tables.load_features(spark, path, ["S1", "S3"], start=date(1996, 1, 1)))
