"""Crossings, entry filters and strategy signals on the bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.backtests import squeeze_parts, ttm_parts
from barline.catalog.registry import query, tidy
from barline.catalog.sql import B, cols, relation, with_
from barline.functions import scalars as S
from barline.functions.series import with_rn
from barline.operators import grid, signals
from barline.operators import indicators as I
from barline.sources import derived

_MA = """
m AS MATERIALIZED (SELECT *, CASE WHEN rn >= 9 THEN avg(close) OVER (
  PARTITION BY symbol ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS ma FROM b)"""


def _cross(x: str, y: str, src: str, name: str) -> str:
    """Relation per bar, then the last unequal one since the last undefined one."""
    return f"""{name} AS MATERIALIZED (
  SELECT *, s = 1 AND was = -1 AS above, s = -1 AND was = 1 AS below FROM (
    SELECT *, last_value(nullif(s, 0) IGNORE NULLS) OVER (
      PARTITION BY symbol, run ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was
    FROM (SELECT *, sum(CASE WHEN s IS NULL THEN 1 ELSE 0 END) OVER (
            PARTITION BY symbol ORDER BY rn) AS run
          FROM (SELECT *, {relation(x, y)} AS s FROM {src}))))"""


_CROSSED = with_(B, _MA, _cross("close", "ma", "m", "x"))


@query(
    "crossings",
    _CROSSED
    + " SELECT symbol, date, coalesce(above, false) AS above, coalesce(below, false) AS below FROM x",
)
def crossings(spark, sf):
    df = I.sma(derived.bars_by_symbol(spark, sf), 10)
    pair = (F.col("close"), F.col("sma"))
    df = signals.crossings(df, {"above": (*pair, "above"), "below": (*pair, "below")})
    return df.select("symbol", "date", "above", "below")


@query(
    "shifted",
    with_(B)
    + f""" SELECT symbol, date, {cols(
      one="lag(close, 1) OVER (PARTITION BY symbol ORDER BY rn)",
      two="lag(close, 2) OVER (PARTITION BY symbol ORDER BY rn)")} FROM b""",
)
def shifted(spark, sf):
    df = signals.shift(derived.bars_by_symbol(spark, sf), "close", 1, "one")
    return tidy(signals.shift(df, "close", 2, "two"), "symbol", "date", "one", "two")


_FLAGS = """
f AS MATERIALIZED (SELECT symbol, date, rn, low, coalesce(close > ma, false) AS entry,
  volume < 12 AS leave FROM m)"""


@query(
    "first_entries",
    with_(
        B,
        _MA,
        _FLAGS,
        """s AS (
          SELECT symbol, rn, date, entry AS hit, entry AS held FROM f WHERE rn = 0
          UNION ALL
          SELECT f.symbol, f.rn, f.date, f.entry AND NOT s.held,
                 CASE WHEN s.held THEN NOT f.leave ELSE f.entry END
          FROM s JOIN f ON f.symbol = s.symbol AND f.rn = s.rn + 1)""",
        recursive=True,
    )
    + " SELECT symbol, date, hit AS first_entry FROM s",
)
def first_entries(spark, sf):
    df = I.sma(derived.bars_by_symbol(spark, sf), 10)
    df = grid.combine(df, "entry", F.col("close") > F.col("sma"))
    df = grid.combine(df, "leave", F.col("volume") < 12)
    return signals.first_entries(df, "entry", "leave").select("symbol", "date", "first_entry")


@query(
    "low_at_entry",
    with_(B, _MA, _FLAGS)
    + f""" SELECT symbol, date, {cols(low_at_entry='''last_value(CASE WHEN entry AND rn > 0 THEN low END
      IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn)''')} FROM f""",
)
def low_at_entry(spark, sf):
    df = I.sma(derived.bars_by_symbol(spark, sf), 10)
    df = grid.combine(df, "entry", F.col("close") > F.col("sma"))
    return tidy(signals.low_at_entry(df, "entry"), "symbol", "date", "low_at_entry")


@query(
    "combined_conditions",
    with_(B, _MA)
    + """ SELECT symbol, date, coalesce(close > ma, false) AND volume > 20 AS both,
      coalesce(close > ma, false) OR volume > 20 AS either, NOT coalesce(close > ma, false) AS neither
    FROM m""",
)
def combined_conditions(spark, sf):
    df = I.sma(derived.bars_by_symbol(spark, sf), 10)
    a, b = F.col("close") > F.col("sma"), F.col("volume") > 20
    return df.select(
        "symbol",
        "date",
        S.all_of(a, b).alias("both"),
        S.any_of(a, b).alias("either"),
        (~S.safe(a)).alias("neither"),
    )


_SPARSE = (
    B + """,
dense AS MATERIALIZED (SELECT symbol, date, rn, open, high, low, close, volume FROM b)"""
)


def _side_by_side(count: int) -> str:
    picks = ", ".join(
        f"bool_or(entry) FILTER (WHERE param_id = {i}) AS entry_{i}, "
        f"bool_or(leave) FILTER (WHERE param_id = {i}) AS exit_{i}"
        for i in range(count)
    )
    return f" SELECT symbol, date, {picks} FROM sig GROUP BY symbol, date"


def _flags(df, count: int):
    names = [f"{side}_{i}" for i in range(count) for side in ("entry", "exit")]
    return df.select("symbol", "date", *names)


@query("squeeze_signals", with_(*squeeze_parts(_SPARSE), recursive=True) + _side_by_side(3))
def squeeze_signals(spark, sf):
    sweep = signals.strategy_params(signals.SQUEEZE)
    return _flags(signals.squeeze_signals(with_rn(derived.bars_by_symbol(spark, sf)), sweep), 3)


@query("ttm_signals", with_(*ttm_parts(_SPARSE), recursive=True) + _side_by_side(2))
def ttm_signals(spark, sf):
    sweep = signals.strategy_params(signals.TTM)
    return _flags(signals.ttm_signals(with_rn(derived.bars_by_symbol(spark, sf)), sweep), 2)
