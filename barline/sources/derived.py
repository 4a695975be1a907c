"""Bars, lots, sectors and reports built from the star-schema tables.

Each function takes ``(spark, sf_dir)``. Line items play the ticks: one row is one trade of a
symbol at ``l_extendedprice / l_quantity``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _symbol(key: str) -> Column:
    return F.concat(F.lit("S"), F.col(key).cast("string"))


def _line_rank() -> Column:
    """Total order of lines as one decimal: (order, line, part) packed into decimal digits.

    A struct would order the same, but a struct in an aggregation buffer forces a sort-based
    aggregate; a decimal keeps ``min_by`` / ``max_by`` in the hash aggregate.
    """
    low = F.col("l_linenumber").cast("bigint") * F.lit(10**11) + F.col("l_partkey")
    high = F.col("l_orderkey").cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)")
    return (high + low.cast("decimal(18,0)")).cast("decimal(38,0)")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        _symbol("l_suppkey").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        _line_rank().alias("rank"),
    )


def bars_from_ticks(t: DataFrame) -> DataFrame:
    """Open, high, low, close and volume per (symbol, date).

    The shuffle is on (symbol, date) after a map-side aggregate, so a symbol holding a third of
    all ticks is spread over its days and each map task sends at most one row per day of it.
    """
    return t.groupBy("symbol", "date").agg(
        F.min_by("price", "rank").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "rank").alias("close"),
        F.sum("quantity").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir))


#: Ticks per partition of bars that windows by symbol follow, so that a task's memory does not grow with the table;
#: fewer where the bars spread over a dense grid, which holds several rows for each.
PART, DENSE_PART = 1 << 18, 1 << 16
#: Ticks per task that groups them to bars.
DEALT = 1 << 19


def _parts(spark: SparkSession, sf_dir: str, part: int) -> int:
    """Partitions of ``part`` ticks, by the count of ticks, which the files' footers hold."""
    return max(-(-table(spark, sf_dir, "lineitem").count() // part), 1)


def dealt_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bars`` from ticks that are dealt by (symbol, date) before they are grouped, in parts sized by their count: a bar
    has hardly more than one tick, so a map-side aggregate would hold nearly every tick of a scan's split at once, and a
    split grows with the table up to what the files compress into 128 MB. A hot symbol spreads over its days."""
    return bars_from_ticks(ticks(spark, sf_dir).repartition(_parts(spark, sf_dir, DEALT), "symbol", "date"))


def by_symbol(spark: SparkSession, sf_dir: str, df: DataFrame, part: int = PART) -> DataFrame:
    """``df`` in partitions by symbol, their number set by the count of ticks. Windows by symbol use this exchange
    instead of one of their own with a fixed number of partitions. A checkpoint or a written table loses it."""
    return df.repartition(_parts(spark, sf_dir, part), "symbol")


def bars_by_symbol(spark: SparkSession, sf_dir: str, part: int = PART) -> DataFrame:
    """``dealt_bars`` in partitions ``by_symbol``."""
    return by_symbol(spark, sf_dir, dealt_bars(spark, sf_dir), part)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as level 3 and nations as level 4; market cap is the sum of account balances."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cap = (
        table(spark, sf_dir, "supplier")
        .groupBy("s_nationkey")
        .agg(F.sum(F.col("s_acctbal").cast("decimal(20,8)")).alias("cap"))
    )
    by_nation = nation.join(cap, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    level4 = by_nation.select(
        F.col("n_nationkey").alias("id"),
        F.lit(4).alias("level"),
        F.lit("nation").alias("type"),
        F.col("n_name").alias("name"),
        F.col("cap").cast(schemas.METRIC).alias("vonhoa_d"),
    )
    by_region = by_nation.groupBy("n_regionkey").agg(F.sum("cap").alias("cap"))
    level3 = region.join(by_region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        F.col("r_regionkey").alias("id"),
        F.lit(3).alias("level"),
        F.lit("region").alias("type"),
        F.col("r_name").alias("name"),
        F.col("cap").cast(schemas.METRIC).alias("vonhoa_d"),
    )
    return level3.unionByName(level4)


def stock_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("s_suppkey").alias("id"),
            _symbol("s_suppkey").alias("symbol"),
            F.col("s_name").alias("name"),
            F.col("n_regionkey").alias("id_sector_level_3"),
            F.col("s_nationkey").alias("id_sector_level_4"),
            F.col("s_acctbal").cast(schemas.METRIC).alias("vonhoa_d"),
        )
    )


def sector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume-weighted close per sector and day, for both levels."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.select(
        F.col("n_nationkey").alias("id_sector_level_4"), F.col("n_name").alias("name4")
    )
    regions = region.select(
        F.col("r_regionkey").alias("id_sector_level_3"), F.col("r_name").alias("name3")
    )
    members = (
        stock_symbols(spark, sf_dir)
        .join(names, "id_sector_level_4")
        .join(regions, "id_sector_level_3")
    )
    daily = (
        bars(spark, sf_dir)
        .join(members, "symbol")
        .groupBy("id_sector_level_3", "name3", "id_sector_level_4", "name4", "date")
        .agg(
            F.sum(F.col("close") * F.col("volume")).alias("traded"),
            F.sum("volume").alias("volume"),
        )
    )
    # both levels out of one pass: the region rows add up the nation rows
    both = daily.select(
        "date",
        "traded",
        "volume",
        F.explode(
            F.array(
                F.struct(
                    F.lit(3).alias("sector_type"),
                    F.col("id_sector_level_3").alias("sector_id"),
                    F.col("name3").alias("sector_name"),
                ),
                F.struct(
                    F.lit(4).alias("sector_type"),
                    F.col("id_sector_level_4").alias("sector_id"),
                    F.col("name4").alias("sector_name"),
                ),
            )
        ).alias("s"),
    )
    return (
        both.groupBy("s.sector_type", "s.sector_id", "s.sector_name", "date")
        .agg(F.sum("traded").alias("traded"), F.sum("volume").alias("volume"))
        .select(
            "sector_type",
            "sector_id",
            "sector_name",
            "date",
            (F.col("traded") / F.col("volume")).alias("close"),
        )
    )


def _dec(c: Column) -> Column:
    return (F.round(c * 1e6) / 1e6).cast(schemas.QTY)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lots: first lines of returnable orders. The id packs the line's key, so no global
    row number (a one-task sort) is needed."""
    li = table(spark, sf_dir, "lineitem").where(
        (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1)
    )
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        (F.col("l_orderkey") * F.lit(10_000_000) + F.col("l_partkey")).alias("id"),
        _symbol("l_suppkey").alias("ticker"),
        F.col("l_quantity").cast(schemas.QTY).alias("quantity"),
        _dec(price).alias("purchase_price"),
        F.to_date("l_shipdate").alias("purchase_date"),
        F.col("l_linestatus").alias("notes"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    sell = F.col("l_returnflag") == "R"
    return li.select(
        (
            (F.col("l_orderkey") * F.lit(10) + F.col("l_linenumber")) * F.lit(10_000_000)
            + F.col("l_partkey")
        ).alias("id"),
        _symbol("l_suppkey").alias("ticker"),
        F.when(sell, F.lit("sell")).otherwise(F.lit("buy")).alias("transaction_type"),
        F.col("l_quantity").cast(schemas.QTY).alias("quantity"),
        _dec(price).alias("price"),
        F.when(sell, _dec(price * (F.lit(1.0) + F.col("l_discount")))).alias("close_price"),
        F.to_date("l_shipdate").alias("transaction_date"),
        F.round(F.col("l_tax") * 10, 2).cast(schemas.FEE).alias("fees"),
        F.col("l_linestatus").alias("notes"),
    )


def close_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each lot, two requests in sequence: half, then a quantity that sometimes is the rest,
    sometimes less and sometimes too much; plus requests for lots that do not exist."""
    lots = positions(spark, sf_dir)
    half = (F.col("quantity") / 2).cast(schemas.QTY)
    second = (
        F.when(F.col("id") % 3 == 0, F.col("quantity") - half)
        .when(F.col("id") % 3 == 1, F.lit(1).cast(schemas.QTY))
        .otherwise(F.col("quantity") + 1)
    )
    parts = F.array(
        F.struct(F.lit(0).alias("n"), half.alias("q"), F.col("id").alias("pid")),
        F.struct(F.lit(1).alias("n"), second.cast(schemas.QTY).alias("q"), F.col("id").alias("pid")),
        F.struct(F.lit(2).alias("n"), F.lit(1).cast(schemas.QTY).alias("q"), (-F.col("id")).alias("pid")),
    )
    return lots.select("purchase_price", "purchase_date", "id", F.explode(parts).alias("p")).select(
        (F.col("id") * 3 + F.col("p.n")).alias("seq"),
        F.col("p.pid").alias("position_id"),
        F.col("p.q").alias("quantity_to_close"),
        (F.col("purchase_price") * F.lit(1.1).cast("decimal(5,2)"))
        .cast(schemas.QTY)
        .alias("closing_price"),
        F.date_add("purchase_date", 30).alias("closing_date"),
        F.lit(1.5).cast(schemas.FEE).alias("fees"),
        F.lit(None).cast("string").alias("notes"),
    )


def investment_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").cast(schemas.MONEY).alias("amount"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("notes"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as research reports; ids repeat, some dates are missing, dates fall in bar range."""
    spread = F.col("event_id") % 2400
    stamp = F.col("ts") - F.make_dt_interval(F.lit(10400) - spread)
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") % 5000).alias("id"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("mack"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("tenbaocao"),
        F.concat(F.lit("r/"), F.col("event_id").cast("string")).alias("url"),
        F.col("event_type").alias("nguon"),
        F.when(F.col("event_id") % 50 != 0, stamp).alias("ngaykn"),
        F.lit(None).cast("string").alias("rsnganh"),
    )


def sector_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import file's JSON, one array of nested key/value entries per region, from suppliers.

    The per-sector figures are aggregated first, so each text is bounded by the number of
    sectors, not by the number of suppliers."""
    nation = table(spark, sf_dir, "nation")
    stats = (
        table(spark, sf_dir, "supplier")
        .groupBy("s_nationkey")
        .agg(
            F.sum(F.col("s_acctbal").cast("decimal(20,2)")).alias("cap"),
            F.count("*").alias("n"),
        )
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )

    def pair(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    entry = F.struct(
        F.col("n_nationkey").cast("string").alias("id"),
        F.col("n_regionkey").cast("string").alias("type"),
        F.array(
            pair("name", F.col("n_name")),
            pair("pe_d", F.lit("1")),
            pair("vonhoa_d", F.col("cap")),
            pair("not_a_metric", F.col("n")),
            pair("pe_d", F.col("n")),
        ).alias("data"),
    )
    return stats.groupBy("n_regionkey").agg(
        F.to_json(F.array_sort(F.collect_list(entry))).alias("value")
    ).select("value")

