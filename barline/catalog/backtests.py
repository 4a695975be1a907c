"""Trades, their profit and the backtests."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barline.catalog.registry import query, r, tidy
from barline.catalog.sql import (
    B,
    DENSE,
    KALMAN,
    anchored_vwap,
    cols,
    flat_mean,
    relation,
    smooth,
    trail,
    true_range,
    with_,
)
from barline.operators import indicators as I
from barline.operators import risk, signals, trades
from barline.plans import backtest, features, scoring
from barline.plans import trees as model_trees
from barline.session import cut_lineage, written
from barline.sources import derived, tables

AS_OF = date(2001, 11, 5)


def _w(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# Trades by walking the bars: state is the entry index while in a trade.
def _walk(src: str, name: str) -> str:
    return f"""{name}_walk AS (
  SELECT symbol, param_id, rn, CASE WHEN entry AND NOT leave THEN rn END AS held,
         CAST(NULL AS INTEGER) AS done FROM {src} WHERE rn = 0
  UNION ALL
  SELECT s.symbol, s.param_id, s.rn,
    CASE WHEN w.held IS NULL THEN CASE WHEN s.entry AND NOT s.leave THEN s.rn END
         WHEN s.leave AND NOT s.entry THEN NULL ELSE w.held END,
    CASE WHEN w.held IS NOT NULL AND s.leave AND NOT s.entry THEN w.held END
  FROM {name}_walk w JOIN {src} s
    ON s.symbol = w.symbol AND s.param_id = w.param_id AND s.rn = w.rn + 1),
{name}_last AS (SELECT symbol, max(rn) AS rn, arg_max(close, rn) AS close FROM {src} GROUP BY symbol),
{name} AS MATERIALIZED (
  SELECT w.symbol, w.param_id, w.done AS entry_idx, w.rn AS exit_idx, a.date AS date,
         z.date AS close_date, a.close AS entry_price, z.close AS exit_price, 'closed_trades' AS type
  FROM {name}_walk w
  JOIN {src} a ON a.symbol = w.symbol AND a.param_id = w.param_id AND a.rn = w.done
  JOIN {src} z ON z.symbol = w.symbol AND z.param_id = w.param_id AND z.rn = w.rn
  WHERE w.done IS NOT NULL
  UNION ALL
  SELECT w.symbol, w.param_id, w.held, NULL, a.date, NULL, a.close, l.close, 'open_trades'
  FROM {name}_walk w JOIN {name}_last l ON l.symbol = w.symbol AND l.rn = w.rn
  JOIN {src} a ON a.symbol = w.symbol AND a.param_id = w.param_id AND a.rn = w.held
  WHERE w.held IS NOT NULL)"""


def _profit(src: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT *, exit_price / entry_price - 1 AS ret,
    100 * coalesce(product(exit_price / entry_price) OVER (PARTITION BY symbol, param_id
      ORDER BY entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)
      * (exit_price / entry_price - 1) AS pnl
  FROM {src})"""


_MA_FLAGS = """
m AS (SELECT *, CASE WHEN rn >= 9 THEN avg(close) OVER (
  PARTITION BY symbol ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS ma FROM b),
flags AS MATERIALIZED (SELECT symbol, 0 AS param_id, date, rn, close,
  coalesce(close > ma, false) AS entry, volume < 20 AS leave FROM m)"""


def _ma_trades(spark, sf):
    df = I.sma(derived.bars_by_symbol(spark, sf), 10)
    df = df.withColumn("entry_0", F.coalesce(F.col("close") > F.col("sma"), F.lit(False)))
    df = df.withColumn("exit_0", F.col("volume") < 20)
    return trades.to_trades(trades.stack_params(df, 1))


@query(
    "signals_to_trades",
    with_(B, _MA_FLAGS, _walk("flags", "t"), _profit("t", "p"), recursive=True)
    + f""" SELECT symbol, entry_idx, exit_idx, date, close_date, type,
      {cols(entry_price="entry_price", exit_price="exit_price", ret="ret")} FROM p""",
)
def signals_to_trades(spark, sf):
    df = _ma_trades(spark, sf).withColumnRenamed("return", "ret")
    return tidy(
        df, "symbol", "entry_idx", "exit_idx", "date", "close_date", "type",
        "entry_price", "exit_price", "ret",
    )


@query(
    "trade_profit",
    with_(B, _MA_FLAGS, _walk("flags", "t"), _profit("t", "p"), recursive=True)
    + f""" SELECT symbol, entry_idx, ret > 0 AS "Y", {cols(3, pnl="pnl / (100 + abs(pnl))")} FROM p""",
)
def trade_profit(spark, sf):
    """Compounded cash can grow without bound on random prices, so pnl is shown squashed."""
    df = trades.label(_ma_trades(spark, sf))
    squashed = F.col("pnl") / (100.0 + F.abs("pnl"))
    return df.select("symbol", "entry_idx", "Y", r(squashed, 3).alias("pnl"))


@query(
    "trade_bars_held",
    with_(B, _MA_FLAGS, _walk("flags", "t"), recursive=True)
    + """ SELECT symbol, entry_idx, exit_idx - entry_idx AS trading_days,
      symbol || '-' || strftime(date, '%Y-%m-%d') || '-' || entry_idx AS id
    FROM t WHERE type = 'closed_trades'""",
)
def trade_bars_held(spark, sf):
    df = trades.with_metadata(_ma_trades(spark, sf), [{"n": 10}])
    return trades.closed_table(df).select("symbol", "entry_idx", "trading_days", "id")


@query(
    "open_trade_age",
    with_(B, _MA_FLAGS, _walk("flags", "t"), recursive=True)
    + """ SELECT symbol, entry_idx, CAST(DATE '2001-11-05' - date AS INTEGER) AS trading_days,
      'n: 10' AS metadata_text FROM t WHERE type = 'open_trades'""",
)
def open_trade_age(spark, sf):
    df = trades.with_metadata(_ma_trades(spark, sf), [{"n": 10}])
    return trades.open_table(df, AS_OF).select("symbol", "entry_idx", "trading_days", "metadata_text")


@query(
    "trades_per_type",
    with_(B, _MA_FLAGS, _walk("flags", "t"), recursive=True)
    + " SELECT type, count(*) AS trades FROM t GROUP BY type",
)
def trades_per_type(spark, sf):
    return _ma_trades(spark, sf).groupBy("type").agg(F.count("*").alias("trades"))


@query(
    "quick_filtered_trades",
    with_(B, _MA_FLAGS, _walk("flags", "t"), recursive=True)
    + """ SELECT symbol, entry_idx, type FROM t
    WHERE contains(lower(concat_ws(chr(1), symbol, CAST(date AS VARCHAR), type)), '1999')""",
)
def quick_filtered_trades(spark, sf):
    hits = trades.text_filter(_ma_trades(spark, sf), "1999", "symbol", "date", "type")
    return hits.select("symbol", "entry_idx", "type")


@query(
    "trades_without_open",
    with_(B, _MA_FLAGS, _walk("flags", "t"), recursive=True)
    + """ SELECT symbol, entry_idx FROM t WHERE type = 'closed_trades'
    AND (symbol, entry_idx) NOT IN (SELECT symbol, entry_idx FROM t WHERE type = 'open_trades')""",
)
def trades_without_open(spark, sf):
    df = _ma_trades(spark, sf)
    opened = df.where(F.col("type") == "open_trades")
    closed = df.where(F.col("type") == "closed_trades")
    return trades.without_open(closed, opened).select("symbol", "entry_idx")


# Strategy backtests on the dense grid, stepped bar by bar in SQL.
def _merged(src: str, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, entry_idx
      ORDER BY CASE WHEN type = 'open_trades' THEN 0 ELSE 1 END, param_id) AS k FROM {src}) WHERE k = 1)"""


def ttm_parts(head: str) -> list[str]:
    """Fragments ending in ``sig``; ``head`` defines the bars to use as ``dense``."""
    parts = [head, true_range("t0", "dense", True), true_range("t1", "dense", False)]
    parts += [
        smooth("mid", "dense", "close", 40, 0, first=True),
        smooth("k12", "t0", "tr", 12, 0, wilder=True),
        smooth("k14", "t0", "tr", 14, 0, wilder=True),
        smooth("a10", "t1", "tr", 10, 1, wilder=True),
        """src AS MATERIALIZED (SELECT d.symbol, d.rn, d.close, a10.y AS atr
          FROM dense d LEFT JOIN a10 USING (symbol, rn))""",
        trail("st", "src", 1.8),
        f"""base AS MATERIALIZED (SELECT d.*, CASE WHEN rn >= 39 THEN mid.y END AS mid,
          coalesce(k12.y, 0) AS k12, coalesce(k14.y, 0) AS k14, st.t AS stop,
          CASE WHEN rn >= 13 THEN {flat_mean("d.close", "w14")} END AS m14,
          CASE WHEN rn >= 13 THEN stddev_pop(d.close) OVER w14 END AS s14,
          CASE WHEN rn >= 15 THEN {flat_mean("d.close", "w16")} END AS m16,
          CASE WHEN rn >= 15 THEN stddev_pop(d.close) OVER w16 END AS s16,
          CASE WHEN rn >= 11 THEN d.close - (max(d.high) OVER w12 + min(d.low) OVER w12
            + {flat_mean("d.close", "w12")}) / 3 END AS hist
          FROM dense d LEFT JOIN mid USING (symbol, rn) LEFT JOIN k12 USING (symbol, rn)
          LEFT JOIN k14 USING (symbol, rn) LEFT JOIN st USING (symbol, rn)
          WINDOW w12 AS (PARTITION BY d.symbol ORDER BY d.rn ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
                 w14 AS (PARTITION BY d.symbol ORDER BY d.rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
                 w16 AS (PARTITION BY d.symbol ORDER BY d.rn ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))""",
        f"""mo AS (SELECT *, CASE WHEN rn >= 22 THEN regr_slope(hist, rn) {_w(12)} * rn
          + regr_intercept(hist, rn) {_w(12)} END AS mom FROM base)""",
        """sg AS (SELECT *, sign(mom) AS s FROM mo)""",
        """wa AS (SELECT *, last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM sg)""",
        """cr AS (SELECT *, coalesce(s = 1 AND was = -1, false) AS c0 FROM wa)""",
        """lg AS MATERIALIZED (SELECT *, lag(mom, 1) OVER o AS m1, lag(mom, 2) OVER o AS m2,
          coalesce(lag(c0, 1) OVER o, false) AS c1, coalesce(lag(c0, 2) OVER o, false) AS c2
          FROM cr WINDOW o AS (PARTITION BY symbol ORDER BY rn))""",
        """sig AS MATERIALIZED (
          SELECT symbol, 0 AS param_id, date, rn, close,
            NOT coalesce(m14 + 1.4 * s14 < mid + 1.2 * k12 AND m14 - 1.4 * s14 > mid - 1.2 * k12, false)
            AND NOT coalesce(m14 + 1.4 * s14 > mid + 1.2 * k12 AND m14 - 1.4 * s14 < mid - 1.2 * k12, false)
            AND (c0 OR (coalesce(mom > m1, false) AND c1) OR (coalesce(mom > m2, false) AND c2)) AS entry,
            coalesce(close < stop, false) AS leave FROM lg
          UNION ALL
          SELECT symbol, 1, date, rn, close,
            NOT coalesce(m16 + s16 < mid + 1.2 * k14 AND m16 - s16 > mid - 1.2 * k14, false)
            AND NOT coalesce(m16 + s16 > mid + 1.2 * k14 AND m16 - s16 < mid - 1.2 * k14, false)
            AND coalesce(mom > 0, false),
            coalesce(close < stop, false) FROM lg)""",
    ]
    return parts


_TRADE_COLS = "symbol entry_idx exit_idx param_id type date close_date".split()


@query(
    "ttm_backtest",
    with_(*ttm_parts(DENSE), _walk("sig", "t"), _merged("t", "u"), recursive=True)
    + f""" SELECT {", ".join(_TRADE_COLS)}, {cols(entry_price="entry_price",
      ret="exit_price / entry_price - 1")} FROM u""",
)
def ttm_backtest(spark, sf):
    df = backtest.backtest(derived.bars_by_symbol(spark, sf, derived.DENSE_PART), signals.TTM, seen=derived.ticks(spark, sf))
    return tidy(df.withColumnRenamed("return", "ret"), *_TRADE_COLS, "entry_price", "ret")


def squeeze_parts(head: str) -> list[str]:
    """As ``ttm_parts``."""
    sweep = signals.strategy_params(signals.SQUEEZE)
    parts = [head, true_range("t0", "dense", True), anchored_vwap("vw", "dense", "lowest")]
    spans = sorted({p["kc_window"] for p in sweep})
    for n in spans:
        parts.append(smooth(f"mid{n}", "dense", "close", n, 0, first=True))
    for n in sorted({*spans, 10}):
        parts.append(smooth(f"k{n}", "t0", "tr", n, 0, wilder=True))
    parts.append(
        """src AS MATERIALIZED (SELECT d.symbol, d.rn, d.close, coalesce(k10.y, 0) AS atr
          FROM dense d LEFT JOIN k10 USING (symbol, rn))"""
    )
    parts.append(trail("st", "src", 1.8))
    bb = sorted({p["bb_window"] for p in sweep})
    picks = [f"CASE WHEN rn >= {n - 1} THEN mid{n}.y END AS mid{n}" for n in spans]
    picks += [f"coalesce(k{n}.y, 0) AS k{n}" for n in sorted({*spans, 10})]
    for n in bb:
        picks.append(f"CASE WHEN rn >= {n - 1} THEN {flat_mean('d.close', f'w{n}')} END AS m{n}")
        picks.append(f"CASE WHEN rn >= {n - 1} THEN stddev_pop(d.close) OVER w{n} END AS s{n}")
    joins = "".join(
        f" LEFT JOIN {t} USING (symbol, rn)"
        for t in [*(f"mid{n}" for n in spans), *(f"k{n}" for n in sorted({*spans, 10})), "vw", "st"]
    )
    windows = ", ".join(
        f"w{n} AS (PARTITION BY d.symbol ORDER BY d.rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for n in bb
    )
    parts.append(
        f"""base AS MATERIALIZED (SELECT d.*, vw.x AS vwap, st.t AS stop, {", ".join(picks)}
          FROM dense d{joins} WINDOW {windows})"""
    )
    parts.append(
        """em AS (SELECT *, nullif(avg(k10) OVER (PARTITION BY symbol ORDER BY rn), 0) AS em0 FROM base),
        th AS MATERIALIZED (SELECT *, greatest(0.1 * k10 / coalesce(last_value(em0 IGNORE NULLS) OVER (
          PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e-9), 0) AS th
          FROM em)"""
    )
    for i, p in enumerate(sweep):
        bm, bs, k = f"m{p['bb_window']}", f"s{p['bb_window']}", p["kc_window"]
        up = f"({bm} + {p['bb_multiplier']} * {bs})"
        lo = f"({bm} - {p['bb_multiplier']} * {bs})"
        ku = f"(mid{k} + {p['kc_multiplier']} * k{k})"
        kl = f"(mid{k} - {p['kc_multiplier']} * k{k})"
        parts.append(
            f"""s{i} AS (SELECT symbol, date, rn, low, close, stop, vwap, {relation('close', up)} AS s,
              coalesce({up} <= {ku} * (1 + th) AND {lo} >= {kl} * (1 - th), false) AS tight FROM th),
            w{i} AS (SELECT *, last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM s{i}),
            e{i} AS (SELECT *, coalesce(close > vwap, false) AND ((coalesce(s = 1 AND was = -1, false) AND tight)
              OR (coalesce(s = 1, false) AND NOT tight)) AS entry FROM w{i}),
            l{i} AS (SELECT *, last_value(CASE WHEN entry AND rn > 0 THEN low END IGNORE NULLS) OVER (
              PARTITION BY symbol ORDER BY rn) AS lae, {relation('close', 'stop')} AS ts FROM e{i}),
            g{i} AS (SELECT *, {relation('close', 'lae')} AS ls FROM l{i}),
            x{i} AS (SELECT *, last_value(nullif(ts, 0) IGNORE NULLS) OVER o AS tw,
              last_value(nullif(ls, 0) IGNORE NULLS) OVER o AS lw FROM g{i}
              WINDOW o AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
        )
    parts.append(
        "sig AS MATERIALIZED ("
        + " UNION ALL ".join(
            f"""SELECT symbol, {i} AS param_id, date, rn, close, entry,
              coalesce(ts = -1 AND tw = 1, false) OR coalesce(ls = -1 AND lw = 1, false) AS leave FROM x{i}"""
            for i in range(len(sweep))
        )
        + ")"
    )
    return parts


@query(
    "squeeze_backtest",
    with_(*squeeze_parts(DENSE), _walk("sig", "t"), _merged("t", "u"), recursive=True)
    + f""" SELECT {", ".join(_TRADE_COLS)}, {cols(entry_price="entry_price",
      ret="exit_price / entry_price - 1")} FROM u""",
)
def squeeze_backtest(spark, sf):
    df = backtest.backtest(derived.bars_by_symbol(spark, sf, derived.DENSE_PART), signals.SQUEEZE, seen=derived.ticks(spark, sf))
    return tidy(df.withColumnRenamed("return", "ret"), *_TRADE_COLS, "entry_price", "ret")


_META = {0: "atr_window: 12, bb_multiplier: 1.4, bb_window: 14, donichan_window: 12, entry_version: v2,"
            " kc_multiplier: 1.2, kc_window: 40, momentum_window: 12",
         1: "atr_window: 14, bb_multiplier: 1.0, bb_window: 16, donichan_window: 12, entry_version: v1,"
            " kc_multiplier: 1.2, kc_window: 40, momentum_window: 12"}


@query(
    "trade_metadata",
    with_(B, _MA_FLAGS, _walk("flags", "t"), recursive=True)
    + f""" SELECT symbol, entry_idx, CASE entry_idx % 2 WHEN 0 THEN '{_META[0]}' ELSE '{_META[1]}' END
      AS metadata_text FROM t""",
)
def trade_metadata(spark, sf):
    """Parameter sets to JSON and back to rendered text, for every trade."""
    df = _ma_trades(spark, sf).withColumn("param_id", F.col("entry_idx") % 2)
    df = trades.with_metadata(df, signals.strategy_params(signals.TTM))
    return df.select("symbol", "entry_idx", "metadata_text")


def _ln(expr: str, guard: int) -> str:
    return f"CASE WHEN rn >= {guard} AND {expr} > 0 THEN ln({expr}) END"


def _z(value: str, n: int) -> str:
    return (
        f"CASE WHEN count({value}) {_w(n)} = {n} THEN ({value} - avg({value}) {_w(n)}) "
        f"/ nullif(stddev_samp({value}) {_w(n)}, 0) END"
    )


def _feature_sql() -> str:
    """Own-series features by the same fragments as the single indicators, ranks by windows."""
    emas = {n: smooth(f"e{n}", "b", "close", n) for n in features.SPANS}
    vol = ", ".join(
        f"""CASE WHEN rn >= {n} THEN sqrt(greatest(avg(o) {_w(n)} + k{n} * avg(c) {_w(n)}
          + (1 - k{n}) * greatest(avg(rs) {_w(n)}, 0), 0)) * sqrt(252::DOUBLE) ELSE 0 END AS yz_vol_{n}"""
        for n in (10, 20)
    )
    parts = [
        B,
        anchored_vwap("vh", "b", "highest"),
        anchored_vwap("vl", "b", "lowest"),
        *emas.values(),
        """ch AS MATERIALIZED (SELECT symbol, rn, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM (
          SELECT symbol, rn, close - lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS d FROM b)
          WHERE d IS NOT NULL)""",
        *[
            smooth(f"{side}{n}", "ch", col, n, 1, wilder=True)
            for n in (5, 14)
            for side, col in (("g", "up"), ("l", "dn"))
        ],
        """fi AS MATERIALIZED (SELECT symbol, rn,
          coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY rn), 0) * volume AS v FROM b)""",
        smooth("ef", "fi", "v", 13, 0, first=True),
        KALMAN,
        """p AS (SELECT *, lag(close) OVER o AS pc, (high + low + close) / 3 AS tp,
          (high + low + close) / 3 - lag((high + low + close) / 3) OVER o AS dt
          FROM b WINDOW o AS (PARTITION BY symbol ORDER BY rn))""",
        """q AS (SELECT *, ln(open / pc) ** 2 AS o, ln(close / open) ** 2 AS c, ln(close / pc) AS lr,
          0.5 * ln(high / low) ** 2 - (2 * ln(2::DOUBLE) - 1) * (ln(close / open) ** 2 + ln(open / pc) ** 2) AS rs,
          0.34::DOUBLE / (1.34::DOUBLE + 11.0::DOUBLE / 9) AS k10,
          0.34::DOUBLE / (1.34::DOUBLE + 21.0::DOUBLE / 19) AS k20,
          CASE WHEN dt > 0 THEN tp * volume ELSE 0 END AS mp, CASE WHEN dt < 0 THEN tp * volume ELSE 0 END AS mn
          FROM p)""",
        f"""w AS MATERIALIZED (SELECT symbol, date, rn, lr AS log_return,
          sum(coalesce(sign(close - pc), 1) * volume) OVER (PARTITION BY symbol ORDER BY rn) AS obv,
          CASE WHEN rn >= 21 THEN CASE WHEN sum(mp) {_w(21)} + sum(mn) {_w(21)} > 0
            THEN 100 * sum(mp) {_w(21)} / (sum(mp) {_w(21)} + sum(mn) {_w(21)}) ELSE 0 END END AS mfi_21,
          {_ln(f"volume / avg(volume) {_w(10)}", 9)} AS volume_threshold_ma_10,
          {_ln(f"volume / avg(volume) {_w(20)}", 19)} AS volume_threshold_ma_20,
          {_z("lr", 10)} AS zscore_10_log_return, {_z("lr", 20)} AS zscore_20_log_return, {vol}
          FROM q)""",
        f"""f AS MATERIALIZED (SELECT symbol, rn, {_z("y", 10)} AS efi_zscore_10, {_z("y", 20)} AS efi_zscore_20
          FROM (SELECT symbol, rn, CASE WHEN rn >= 12 THEN y END AS y FROM ef))""",
        f"""z AS MATERIALIZED (SELECT symbol, rn, y, {_z("y", 10)} AS zscore_kf_10, {_z("y", 20)} AS zscore_kf_20 FROM kf)""",
    ]
    rank = []
    for n in (10, 20):
        parts.append(
            f"""r{n} AS (SELECT symbol, date, ret - avg(ret) OVER (PARTITION BY date) AS rs FROM (
              SELECT symbol, date, close / lag(close, {n}) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret FROM b)),
            x{n} AS MATERIALIZED (SELECT symbol, date, rs, percent_rank() OVER (PARTITION BY date ORDER BY rs) AS k
              FROM r{n} WHERE rs IS NOT NULL)"""
        )
        rank.append(f" LEFT JOIN x{n} ON x{n}.symbol = b.symbol AND x{n}.date = b.date")

    def rsi(n: int) -> str:
        g, l = f"g{n}.y", f"l{n}.y"
        return f"CASE WHEN {g} + {l} > 0 THEN 100 * {g} / ({g} + {l}) WHEN {g} IS NOT NULL THEN 0 END"

    out = {"rsi_window_5": rsi(5), "rsi_window_14": rsi(14)}
    out |= {f"ema_{n}_distance": f"ln(b.close / e{n}.y)" for n in features.SPANS}
    out |= {
        "vwap_distance_highest": "ln(b.close / vh.x)",
        "vwap_distance_lowest": "ln(b.close / vl.x)",
        "kf_distance": "ln(b.close / z.y)",
    }
    for n in (10, 20):
        out |= {f"rs_{n}": f"x{n}.rs", f"msr_rank_{n}": f"x{n}.k"}
    plain = [c for c in features.FEATURES if c not in out]
    out |= {c: c for c in plain}
    joins = "".join(
        f" LEFT JOIN {t} ON {t}.symbol = b.symbol AND {t}.rn = b.rn"
        for t in [*(f"e{n}" for n in features.SPANS), "g5", "l5", "g14", "l14", "vh", "vl", "f", "w", "z"]
    )
    return with_(*parts, recursive=True) + (
        f" SELECT b.symbol, b.date, {cols(3, **out)} FROM b{joins}{''.join(rank)}"
    )


@query("feature_table", _feature_sql())
def feature_table(spark, sf):
    return tidy(features.feature_table(derived.bars_by_symbol(spark, sf)), digits=3)


@query(
    "market_relative_strength",
    with_(B)
    + f""", q AS (SELECT symbol, date, close / lag(close, 10) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret
      FROM b),
    x AS (SELECT symbol, date, ret - avg(ret) OVER (PARTITION BY date) AS rs FROM q),
    k AS (SELECT symbol, date, percent_rank() OVER (PARTITION BY date ORDER BY rs) AS k
      FROM x WHERE rs IS NOT NULL)
    SELECT symbol, date, {cols(rs_10="rs", msr_rank_10="k")} FROM x LEFT JOIN k USING (symbol, date)""",
)
def market_relative_strength(spark, sf):
    df = features.cross_section(derived.bars_by_symbol(spark, sf), [10])
    return tidy(df, "symbol", "date", "rs_10", "msr_rank_10")


_FEATURE_SRC = f"""
f AS MATERIALIZED (SELECT symbol, date, CASE WHEN rn >= 19 THEN ln(close / avg(close) {_w(20)}) END AS fx,
  CASE WHEN rn >= 9 THEN ln(volume / avg(volume) {_w(10)}) END AS fy FROM b)"""


def _small_features(spark, sf, bars=None):
    bars = derived.bars_by_symbol(spark, sf) if bars is None else bars
    df = I.sma(I.sma(bars, 20, out="a"), 10, "volume", "v")
    from barline.functions import scalars as S

    return df.select(
        "symbol",
        "date",
        S.log_distance(F.col("close"), F.col("a")).alias("fx"),
        S.log_distance(F.col("volume"), F.col("v")).alias("fy"),
    )


@query(
    "trades_with_features",
    with_(B, _MA_FLAGS, _walk("flags", "t"), _FEATURE_SRC, recursive=True)
    + f""" SELECT symbol, date, entry_idx, exit_price / entry_price - 1 > 0 AS "Y",
      {cols(fx="fx", fy="fy")} FROM t JOIN f USING (symbol, date) WHERE fx IS NOT NULL AND fy IS NOT NULL""",
)
def trades_with_features(spark, sf):
    df = features.join_features(_ma_trades(spark, sf), _small_features(spark, sf))
    return tidy(df, "symbol", "date", "entry_idx", "Y", "fx", "fy")


@query(
    "standardized_features",
    with_(B, _FEATURE_SRC)
    + f""", g AS MATERIALIZED (SELECT * FROM f WHERE fx IS NOT NULL AND fy IS NOT NULL),
    s AS MATERIALIZED (SELECT avg(fx) AS mx, stddev_pop(fx) AS sx, avg(fy) AS my, stddev_pop(fy) AS sy FROM g)
    SELECT symbol, date, {cols(fx="(fx - mx) / sx", fy="(fy - my) / sy")} FROM g, s""",
)
def standardized_features(spark, sf):
    df = _small_features(spark, sf).na.drop("any", subset=["fx", "fy"])
    return tidy(risk.standardize(df, ["fx", "fy"]))


@query(
    "filtered_features",
    with_(B, _FEATURE_SRC)
    + f""" SELECT symbol, date, {cols(fx="fx", fy="fy")} FROM f
    WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'""",
)
def filtered_features(spark, sf):
    df = tables.filter_bars(
        _small_features(spark, sf), start=date(1998, 1, 1), end=date(1999, 12, 31)
    )
    return tidy(df)


@query(
    "scored_trades_logistic",
    with_(B, _MA_FLAGS, _walk("flags", "t"), _FEATURE_SRC, recursive=True)
    + f""", j AS MATERIALIZED (SELECT symbol, date, entry_idx, exit_price / entry_price - 1 > 0 AS y, fx, fy
      FROM t JOIN f USING (symbol, date) WHERE fx IS NOT NULL AND fy IS NOT NULL),
    s AS (SELECT avg(fx) AS mx, stddev_pop(fx) AS sx, avg(fy) AS my, stddev_pop(fy) AS sy FROM j)
    SELECT symbol, date, entry_idx, y AS "Y",
      {cols(fx="fx", y_pred="1 / (1 + exp(-(0.3 + 0.8 * (fx - mx) / sx - 0.5 * (fy - my) / sy)))")} FROM j, s""",
)
def scored_trades_logistic(spark, sf):
    """The scoring step with a model of given coefficients: features keep their values."""
    df = features.join_features(_ma_trades(spark, sf), _small_features(spark, sf))
    scored = scoring.score_logistic(df, {"fx": 0.8, "fy": -0.5}, 0.3)
    return tidy(scored, "symbol", "date", "entry_idx", "Y", "fx", "y_pred")


@query("scored_trades")
def scored_trades(spark, sf):
    """Three models trained on the trades' own labels, then applied to all of them."""
    bars = written(derived.dealt_bars(spark, sf), "bars")
    dealt = derived.by_symbol(spark, sf, bars, derived.DENSE_PART)
    made = written(backtest.backtest(dealt, signals.TTM, seen=bars).select("symbol", "date", "entry_idx", "return"), "trades")
    at = derived.by_symbol(spark, sf, made.select("symbol", "date"), derived.DENSE_PART)
    joined = features.join_features(made, features.feature_table(dealt, at))
    joined = cut_lineage(joined)
    models = scoring.train(joined)
    scored = scoring.score(joined, models)
    return tidy(scored, "symbol", "date", "entry_idx", "Y", *[f"y_pred_{m}" for m in models])


# Given ensembles over the standardised fx and fy, as (tree, node, feature, threshold, left, right, value, weight).
_BOOSTED = (
    (0, 0, "fx", 0.1, 1, 2, None, 1.0), (0, 1, "fy", -0.4, 3, 4, None, 1.0), (0, 2, None, None, None, None, 0.7, 1.0),
    (0, 3, None, None, None, None, -0.6, 1.0), (0, 4, None, None, None, None, 0.2, 1.0),
    (1, 0, "fy", 0.3, 1, 2, None, 0.5), (1, 1, None, None, None, None, -0.3, 0.5), (1, 2, "fx", -1.1, 3, 4, None, 0.5),
    (1, 3, None, None, None, None, 0.9, 0.5), (1, 4, None, None, None, None, -0.8, 0.5),
)
_FOREST = (
    (0, 0, "fx", -0.2, 1, 2, None, 1.0), (0, 1, None, None, None, None, 0.31, 1.0), (0, 2, None, None, None, None, 0.64, 1.0),
    (1, 0, "fy", 0.8, 1, 2, None, 1.0), (1, 1, "fy", -0.9, 3, 4, None, 1.0), (1, 2, None, None, None, None, 0.12, 1.0),
    (1, 3, None, None, None, None, 0.77, 1.0), (1, 4, None, None, None, None, 0.45, 1.0),
)
_MODELS = {
    "xgb": model_trees.Trees(_BOOSTED, "logistic", 2.0, -0.1),
    "lgbm": model_trees.Trees(_FOREST, "mean"),
    "catboost": model_trees.Linear({"fx": 0.8, "fy": -0.5}, 0.3),
}


def _nodes(name: str, nodes: tuple) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    rows = ", ".join("(" + ", ".join(cell(v) for v in n) + ")" for n in nodes)
    return f"{name}_nodes(tree, node, feature, threshold, l, r, value, weight) AS (VALUES {rows})"


def _walk_trees(name: str, total: str) -> str:
    """Every scaled row steps down every tree of a node table until it reaches a leaf."""
    return f"""{name}_at AS (
  SELECT q.symbol, q.entry_idx, q.zx, q.zy, n.* FROM q, {name}_nodes n WHERE n.node = 0
  UNION ALL
  SELECT a.symbol, a.entry_idx, a.zx, a.zy, n.* FROM {name}_at a JOIN {name}_nodes n ON n.tree = a.tree
    AND n.node = CASE WHEN CASE a.feature WHEN 'fx' THEN a.zx ELSE a.zy END <= a.threshold THEN a.l ELSE a.r END
  WHERE a.feature IS NOT NULL),
{name} AS (SELECT symbol, entry_idx, {total} AS p FROM {name}_at WHERE feature IS NULL GROUP BY symbol, entry_idx)"""


def _scored(src: str) -> list[str]:
    """Fragments that end in ``scored``: the rows of ``src`` (with fx and fy) and the three probabilities."""
    return [
        _nodes("xgb", _BOOSTED),
        _nodes("lgbm", _FOREST),
        f"s AS MATERIALIZED (SELECT avg(fx) AS mx, stddev_pop(fx) AS sx, avg(fy) AS my, stddev_pop(fy) AS sy FROM {src})",
        f"q AS MATERIALIZED (SELECT {src}.*, (fx - mx) / sx AS zx, (fy - my) / sy AS zy FROM {src}, s)",
        _walk_trees("xgb", "1 / (1 + exp(-(-0.1 + 2 * sum(weight * value))))"),
        _walk_trees("lgbm", "sum(weight * value) / sum(weight)"),
        """scored AS MATERIALIZED (SELECT q.*, xgb.p AS y_pred_xgb, lgbm.p AS y_pred_lgbm,
             1 / (1 + exp(-(0.3 + 0.8 * zx - 0.5 * zy))) AS y_pred_catboost
           FROM q JOIN xgb USING (symbol, entry_idx) JOIN lgbm USING (symbol, entry_idx))""",
    ]


_PREDICTED = cols(y_pred_xgb="y_pred_xgb", y_pred_lgbm="y_pred_lgbm", y_pred_catboost="y_pred_catboost")


@query(
    "scored_trades_trees",
    with_(
        B, _MA_FLAGS, _walk("flags", "t"), _FEATURE_SRC,
        """j AS MATERIALIZED (SELECT symbol, date, entry_idx, exit_price / entry_price - 1 > 0 AS y, fx, fy
          FROM t JOIN f USING (symbol, date) WHERE fx IS NOT NULL AND fy IS NOT NULL)""",
        *_scored("j"), recursive=True,
    )
    + f""" SELECT symbol, date, entry_idx, y AS "Y", {cols(fx="fx")}, {_PREDICTED} FROM scored""",
)
def scored_trades_trees(spark, sf):
    """Boosted trees, a forest and a logistic model, given as node tables and coefficients."""
    df = features.join_features(_ma_trades(spark, sf), _small_features(spark, sf))
    scored = scoring.score(written(df, "trades"), _MODELS, None)
    return tidy(scored, "symbol", "date", "entry_idx", "Y", "fx", *[f"y_pred_{m}" for m in _MODELS])


_BACKTEST_SCORED = with_(
    *ttm_parts(DENSE),
    _walk("sig", "t"),
    _profit("t", "p"),
    _merged("p", "u"),
    "b AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS rn FROM bars)",
    _FEATURE_SRC,
    """ms AS (SELECT symbol, date, ret - avg(ret) OVER (PARTITION BY date) AS rs FROM (
      SELECT symbol, date, close / lag(close, 10) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret FROM b)),
    mr AS MATERIALIZED (SELECT symbol, date, percent_rank() OVER (PARTITION BY date ORDER BY rs) AS msr
      FROM ms WHERE rs IS NOT NULL)""",
    """j AS MATERIALIZED (SELECT u.*, fx, fy, msr FROM u JOIN f USING (symbol, date) JOIN mr USING (symbol, date)
      WHERE fx IS NOT NULL AND fy IS NOT NULL)""",
    *_scored("j"),
    f"""shown AS (SELECT *, CASE param_id WHEN 0 THEN '{_META[0]}' ELSE '{_META[1]}' END AS metadata_text,
      symbol || '-' || strftime(date, '%Y-%m-%d') || '-' || entry_idx AS id FROM scored)""",
    recursive=True,
)
_MONEY = cols(3, pnl="pnl / (100 + abs(pnl))")


def _backtest_scored(spark, sf):
    """The ticks are read once. Written bars have lost their partitions, so they are dealt by symbol again."""
    bars = written(derived.dealt_bars(spark, sf), "bars")
    dealt = derived.by_symbol(spark, sf, bars, derived.DENSE_PART)
    small = _small_features(spark, sf, derived.by_symbol(spark, sf, bars)).join(
        features.cross_section(derived.by_symbol(spark, sf, bars), [10]).select("symbol", "date", "msr_rank_10"), ["symbol", "date"]
    )
    return backtest.scored_backtest(dealt, small, _MODELS, signals.TTM, AS_OF, names=None, seen=bars)


def _shown(df):
    """Compounded cash can grow without bound on random prices, so pnl is shown squashed."""
    squashed = r(F.col("pnl") / (100.0 + F.abs("pnl")), 3)
    return tidy(df.withColumn("pnl", squashed))


@query(
    "scored_backtest_open",
    _BACKTEST_SCORED
    + f""" SELECT symbol, date, {cols(entry_price="entry_price")}, {_MONEY}, metadata_text, type, entry_idx,
      CAST(DATE '{AS_OF}' - date AS INTEGER) AS trading_days, id, {_PREDICTED}, {cols(msr_rank_10="msr")}
    FROM shown WHERE type = 'open_trades'""",
)
def scored_backtest_open(spark, sf):
    return _shown(_backtest_scored(spark, sf)[0])


@query(
    "scored_backtest_closed",
    _BACKTEST_SCORED
    + f""" SELECT symbol, date, close_date, {cols(entry_price="entry_price")}, {_MONEY}, exit_idx - entry_idx AS trading_days,
      metadata_text, type, entry_idx, exit_idx, id, {_PREDICTED}, {cols(msr_rank_10="msr")}
    FROM shown WHERE type = 'closed_trades'""",
)
def scored_backtest_closed(spark, sf):
    return _shown(_backtest_scored(spark, sf)[1])
