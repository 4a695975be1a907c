"""Signals to trades, profit and the backtest's table algebra."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import scalars as S
from barline.functions.series import KEY, RN

CASH = 100.0


def stack_params(signals: DataFrame, count: int) -> DataFrame:
    """Side-by-side signal pairs to rows, keeping only bars where exactly one of entry and exit
    is set: bars with both are ignored by the trade rules and all others say nothing. Bars
    without signals are gone before anything is shuffled or sorted again."""
    last = F.last("close").over(
        Window.partitionBy(KEY)
        .orderBy(RN)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    sides = F.array(
        *[
            F.struct(
                F.lit(i).alias("param_id"),
                F.when(F.col(f"entry_{i}") & ~F.col(f"exit_{i}"), True)
                .when(F.col(f"exit_{i}") & ~F.col(f"entry_{i}"), False)
                .alias("enter"),
            )
            for i in range(count)
        ]
    )
    rows = signals.withColumn("_last", last).withColumn(
        "_s", F.explode(F.filter(sides, lambda s: s["enter"].isNotNull()))
    )
    return rows.select(
        KEY, "date", RN, "close", "_last", F.col("_s.param_id").alias("param_id"),
        F.col("_s.enter").alias("enter"),
    )


def to_trades(events: DataFrame) -> DataFrame:
    """Long-only trades, all-in, no fees: enter at the close when flat, leave at the close of the
    next exit, possibly re-enter later. A trade without exit is open and valued at the last close.

    Among rows that are plain entries or exits, a trade starts wherever an entry follows an exit
    or nothing, and ends at the next row of the other kind.
    """
    w = Window.partitionBy(KEY, "param_id").orderBy(RN)
    turns = (
        events.withColumn("_prev", F.coalesce(F.lag("enter").over(w), F.lit(False)))
        .where(F.col("enter") != F.col("_prev"))
        .withColumn("exit_idx", F.lead(RN).over(w))
        .withColumn("close_date", F.lead("date").over(w))
        .withColumn("_out", F.lead("close").over(w))
        .where("enter")
    )
    closed = F.col("exit_idx").isNotNull()
    trades = turns.select(
        KEY,
        "param_id",
        "date",
        F.col(RN).alias("entry_idx"),
        F.col("close").alias("entry_price"),
        "exit_idx",
        "close_date",
        F.coalesce("_out", "_last").alias("exit_price"),
        F.when(closed, F.lit("closed_trades")).otherwise(F.lit("open_trades")).alias("type"),
    )
    return with_profit(trades)


def with_profit(trades: DataFrame) -> DataFrame:
    """return = exit/entry - 1; pnl on compounding cash: 100 times the growth of the earlier
    trades of the same symbol and parameter set, all of it invested."""
    w = Window.partitionBy(KEY, "param_id").orderBy("entry_idx").rowsBetween(
        Window.unboundedPreceding, -1
    )
    growth = F.ln(F.col("exit_price") / F.col("entry_price"))
    return (
        trades.withColumn("return", F.col("exit_price") / F.col("entry_price") - 1.0)
        .withColumn("_g", growth)
        .withColumn("cash", F.lit(CASH) * F.exp(F.coalesce(F.sum("_g").over(w), F.lit(0.0))))
        .withColumn("pnl", F.col("cash") * F.col("return"))
        .drop("_g")
    )


def merge_param_sets(trades: DataFrame) -> DataFrame:
    """One trade per (symbol, entry_idx) over all parameter sets: a closed trade gives way to an
    open one with the same key, and among equals the first parameter set stays.

    A bounded group (one row per parameter set), ranked by aggregation: open beats closed, then
    the lowest ``param_id``. That is the anti-join, union and keep-first in one shuffle.
    """
    rest = [c for c in trades.columns if c not in (KEY, "entry_idx", "type")]
    # One number, so that the aggregate hashes: open ones first, then by parameter set.
    closed = F.when(F.col("type") == "open_trades", 0).otherwise(1).cast("long")
    rank = closed * F.lit(1 << 32) + F.col("param_id")
    best = trades.groupBy(KEY, "entry_idx").agg(
        F.min(rank).alias("_rank"), *[F.min_by(c, rank).alias(c) for c in rest]
    )
    kind = F.when(F.col("_rank") < 1 << 32, F.lit("open_trades")).otherwise(F.lit("closed_trades"))
    return best.withColumn("type", kind).select(KEY, "entry_idx", *[c for c in trades.columns if c not in (KEY, "entry_idx")])


def without_open(closed: DataFrame, opened: DataFrame) -> DataFrame:
    """Closed trades whose (symbol, entry_idx) is not among the open ones."""
    return closed.join(opened.select(KEY, "entry_idx").distinct(), [KEY, "entry_idx"], "left_anti")


def label(trades: DataFrame) -> DataFrame:
    return trades.withColumn("Y", F.col("return") > 0)


def with_metadata(trades: DataFrame, sweep: list[dict]) -> DataFrame:
    """Parameter set as JSON text, as a map, and rendered ``k: v, k: v``."""
    maps = F.array(
        *[
            F.create_map(*[F.lit(x) for k, v in p.items() for x in (k, str(v))])
            for p in sweep
        ]
    )
    df = trades.withColumn("metadata_json", F.to_json(F.element_at(maps, F.col("param_id") + 1)))
    parsed = F.from_json("metadata_json", "map<string,string>")
    return df.withColumn("metadata", parsed).withColumn(
        "metadata_text", S.render_map(F.col("metadata"))
    )


def open_table(trades: DataFrame, as_of: date, *extra: str) -> DataFrame:
    """Open trades with their age in days; newest entry first when presented."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("date"))
    return trades.where(F.col("type") == "open_trades").select(
        KEY, "date", "entry_price", "pnl", "metadata_text", "type", "entry_idx",
        age.alias("trading_days"), _trade_id(), *extra,
    )


def closed_table(trades: DataFrame, *extra: str) -> DataFrame:
    """Closed trades with their length in bars (not days)."""
    return trades.where(F.col("type") == "closed_trades").select(
        KEY, "date", "close_date", "entry_price", "pnl",
        (F.col("exit_idx") - F.col("entry_idx")).alias("trading_days"),
        "metadata_text", "type", "entry_idx", "exit_idx", _trade_id(), *extra,
    )


def _trade_id():
    return F.concat_ws(
        "-", F.col(KEY), S.iso_day(F.col("date")), F.col("entry_idx").cast("string")
    ).alias("id")


def text_filter(df: DataFrame, term: str, *cols: str) -> DataFrame:
    """Rows where any of the columns, as text, contains the term."""
    joined = F.lower(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cols or df.columns]))
    return df.where(joined.contains(term.lower()))


def newest_first(df: DataFrame, col: str) -> DataFrame:
    return df.orderBy(F.col(col).desc(), KEY, "entry_idx")
