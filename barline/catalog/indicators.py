"""Technical indicators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barline.catalog.registry import SQL, query, tidy
from barline.catalog.sql import B, B_GAPS, KALMAN, anchored_vwap, cols, flat_mean, smooth, trail, true_range, with_
from barline.functions.series import with_rn
from barline.operators import indicators as I
from barline.plans.indicators import Spec, with_indicators
from barline.session import checkpoint_dir
from barline.sources import derived, stored


def _w(n: int, order: str = "rn") -> str:
    return f"OVER (PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n: int, expr: str) -> str:
    return f"CASE WHEN rn >= {n - 1} THEN {expr} END"


@query("sma", with_(B) + f" SELECT symbol, date, {cols(sma=_full(20, f'avg(close) {_w(20)}'))} FROM b")
def sma(spark, sf):
    return tidy(I.sma(derived.bars_by_symbol(spark, sf), 20), "symbol", "date", "sma")


def _joined(value: str, name: str) -> str:
    return f" SELECT b.symbol, b.date, {cols(**{name: value})} FROM b LEFT JOIN e USING (symbol, rn)"


@query("ema", with_(B, smooth("e", "b", "close", 20), recursive=True) + _joined("e.y", "ema"))
def ema(spark, sf):
    return tidy(I.ema(derived.bars_by_symbol(spark, sf), 20), "symbol", "date", "ema")


_CHANGES = """
d AS MATERIALIZED (
  SELECT symbol, rn, greatest(c, 0) AS up, greatest(-c, 0) AS dn FROM (
    SELECT symbol, rn, close - lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS c FROM b)
  WHERE c IS NOT NULL)"""


def _rsi_value(g: str, l: str) -> str:
    return f"CASE WHEN {g} + {l} > 0 THEN 100 * {g} / ({g} + {l}) WHEN {g} IS NOT NULL THEN 0 END"


@query(
    "rsi",
    with_(
        B,
        _CHANGES,
        smooth("g14", "d", "up", 14, 1, wilder=True),
        smooth("l14", "d", "dn", 14, 1, wilder=True),
        smooth("g5", "d", "up", 5, 1, wilder=True),
        smooth("l5", "d", "dn", 5, 1, wilder=True),
        recursive=True,
    )
    + f""" SELECT b.symbol, b.date,
      {cols(rsi=_rsi_value("g14.y", "l14.y"), rsi_5=_rsi_value("g5.y", "l5.y"))}
    FROM b LEFT JOIN g14 USING (symbol, rn) LEFT JOIN l14 USING (symbol, rn)
    LEFT JOIN g5 USING (symbol, rn) LEFT JOIN l5 USING (symbol, rn)""",
)
def rsi(spark, sf):
    return tidy(I.rsi_pair(derived.bars_by_symbol(spark, sf), 14), "symbol", "date", "rsi", "rsi_5")


@query(
    "macd",
    with_(
        B,
        smooth("f", "b", "close", 12, 14),
        smooth("s", "b", "close", 26),
        "line AS MATERIALIZED (SELECT symbol, rn, f.y - s.y AS v FROM f JOIN s USING (symbol, rn))",
        smooth("g", "line", "v", 9, 25),
        recursive=True,
    )
    + f""" SELECT b.symbol, b.date, {cols(macd="CASE WHEN g.y IS NOT NULL THEN line.v END",
      macd_signal="g.y", macd_hist="line.v - g.y")}
    FROM b LEFT JOIN line USING (symbol, rn) LEFT JOIN g USING (symbol, rn)""",
)
def macd(spark, sf):
    df = I.macd(derived.bars_by_symbol(spark, sf))
    return tidy(df, "symbol", "date", "macd", "macd_signal", "macd_hist")


@query(
    "bollinger",
    with_(B)
    + f""", m AS (SELECT symbol, date, {_full(20, flat_mean("close", _w(20)[5:]))} AS m,
      {_full(20, f"stddev_pop(close) {_w(20)}")} AS s FROM b)
    SELECT symbol, date, {cols(bb_upper="m + 2 * s", bb_middle="m", bb_lower="m - 2 * s")} FROM m""",
)
def bollinger(spark, sf):
    df = I.bollinger(derived.bars_by_symbol(spark, sf), 20, 2.0, 2.0)
    return tidy(df, "symbol", "date", "bb_upper", "bb_middle", "bb_lower")


@query(
    "atr",
    with_(B, true_range("t", "b", False), smooth("e", "t", "tr", 14, 1, wilder=True), recursive=True)
    + _joined("e.y", "atr"),
)
def atr(spark, sf):
    return tidy(I.atr(derived.bars_by_symbol(spark, sf), 14), "symbol", "date", "atr")


@query(
    "atr_zero_warmup",
    with_(B, true_range("t", "b", True), smooth("e", "t", "tr", 10, 0, wilder=True), recursive=True)
    + _joined("coalesce(e.y, 0)", "atr"),
)
def atr_zero_warmup(spark, sf):
    return tidy(I.atr_zero_warmup(derived.bars_by_symbol(spark, sf), 10), "symbol", "date", "atr")


@query(
    "atr_trailing",
    with_(
        B,
        true_range("t", "b", False),
        smooth("e", "t", "tr", 10, 1, wilder=True),
        "src AS MATERIALIZED (SELECT b.symbol, b.rn, b.close, e.y AS atr"
        " FROM b LEFT JOIN e USING (symbol, rn))",
        trail("st", "src", 1.8),
        recursive=True,
    )
    + f""" SELECT b.symbol, b.date, {cols(atr_trailing="st.t")} FROM b JOIN st USING (symbol, rn)""",
)
def atr_trailing(spark, sf):
    return tidy(I.atr_trailing(derived.bars_by_symbol(spark, sf), 10, 1.8), "symbol", "date", "atr_trailing")


def _vwap_sql(side: str) -> str:
    return (
        with_(B, anchored_vwap("v", "b", side))
        + f" SELECT b.symbol, b.date, {cols(**{f'vwap_{side}': 'v.x'})} FROM b JOIN v USING (symbol, rn)"
    )


@query("vwap_highest", _vwap_sql("highest"))
def vwap_highest(spark, sf):
    df = I.anchored_vwap(derived.bars_by_symbol(spark, sf), "highest")
    return tidy(df, "symbol", "date", "vwap_highest")


@query("vwap_lowest", _vwap_sql("lowest"))
def vwap_lowest(spark, sf):
    df = I.anchored_vwap(derived.bars_by_symbol(spark, sf), "lowest")
    return tidy(df, "symbol", "date", "vwap_lowest")


def _beta_sql(x: str, a: float, b: float) -> str:
    """Power series of the regularised incomplete beta function with log-gamma terms."""
    return f"""(list_sum(list_transform(range(0, 60), lambda k:
      exp(lgamma(k + 1 - {b}) - lgamma(1 - {b}) - lgamma(k + 1)) / ({a} + k) * pow({x}, k)))
      * pow({x}, {a}) / exp(lgamma({a}) + lgamma({b}) - lgamma({a} + {b})))"""


@query(
    "bvc",
    with_(
        B,
        """r AS (SELECT *, coalesce(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY rn)), 0) AS r
          FROM b)""",
        """z AS (SELECT *, r / nullif(stddev_pop(r) OVER (PARTITION BY symbol ORDER BY rn
          ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS z FROM r)""",
        "x AS (SELECT *, z * z / (0.25 + z * z) AS x, 0.25 / (0.25 + z * z) AS y FROM z)",
        f"""q AS (SELECT *, CASE WHEN x <= 0.5 THEN {_beta_sql("least(x, 0.5)", 0.5, 0.125)}
          ELSE 1 - {_beta_sql("least(y, 0.5)", 0.125, 0.5)}
          END AS p FROM x)""",
        """l AS MATERIALIZED (SELECT symbol, rn,
          CASE WHEN rn >= 20 THEN volume * coalesce(sign(z) * p, 0) ELSE 0 END AS v FROM q)""",
        """e AS (SELECT symbol, rn, v AS y FROM l WHERE rn = 0
          UNION ALL SELECT l.symbol, l.rn, e.y * exp(-0.1::DOUBLE) + l.v
          FROM e JOIN l ON l.symbol = e.symbol AND l.rn = e.rn + 1)""",
        recursive=True,
    )
    + _joined("CASE WHEN rn >= 20 THEN e.y / 100000 END", "bvc"),
)
def bvc(spark, sf):
    return tidy(I.bvc(derived.bars_by_symbol(spark, sf)), "symbol", "date", "bvc")


@query(
    "stochastic",
    with_(B)
    + f""", h AS (SELECT *, max(high) {_w(14)} AS hh, min(low) {_w(14)} AS ll FROM b),
    k AS (SELECT *, {_full(14, "CASE WHEN hh - ll > 0 THEN 100 * (close - ll) / (hh - ll) ELSE 0 END")} AS k FROM h),
    sk AS (SELECT *, {_full(16, f"avg(k) {_w(3)}")} AS sk FROM k)
    SELECT symbol, date, {cols(slowk=_full(18, "sk"), slowd=_full(18, f"avg(sk) {_w(3)}"))} FROM sk""",
)
def stochastic(spark, sf):
    return tidy(I.stochastic(derived.bars_by_symbol(spark, sf)), "symbol", "date", "slowk", "slowd")


@query("kalman", with_(B, KALMAN, "e AS (SELECT symbol, rn, y FROM kf)", recursive=True) + _joined("e.y", "kf"))
def kalman(spark, sf):
    return tidy(I.kalman(derived.bars_by_symbol(spark, sf)), "symbol", "date", "kf")


@query(
    "kalman_zscore",
    with_(
        B,
        KALMAN,
        f"""e AS (SELECT symbol, rn, coalesce({_full(20, f"(y - avg(y) {_w(20)}) / nullif(stddev_samp(y) {_w(20)}, 0)")}, 0) AS y
          FROM kf)""",
        recursive=True,
    )
    + _joined("e.y", "kalman_zscore"),
)
def kalman_zscore(spark, sf):
    return tidy(I.kalman_zscore(derived.bars_by_symbol(spark, sf)), "symbol", "date", "kalman_zscore")


@query(
    "yz_volatility",
    with_(B)
    + f""", p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS pc FROM b),
    s AS (SELECT *, ln(open / pc) ** 2 AS o, ln(close / open) ** 2 AS c, ln(high / low) ** 2 AS h FROM p),
    t AS (SELECT *, 0.5 * h - (2 * ln(2::DOUBLE) - 1) * (c + o) AS rs FROM s),
    m AS (SELECT symbol, date, rn, avg(o) {_w(30)} AS mo, avg(c) {_w(30)} AS mc, avg(rs) {_w(30)} AS mr FROM t),
    k AS (SELECT 0.34::DOUBLE / (1.34::DOUBLE + 31.0::DOUBLE / 29) AS k)
    SELECT symbol, date, {cols(yz_volatility='''CASE WHEN rn >= 30 THEN
      sqrt(greatest(mo + k * mc + (1 - k) * greatest(mr, 0), 0)) * sqrt(252::DOUBLE) ELSE 0 END''')}
    FROM m, k""",
)
def yz_volatility(spark, sf):
    return tidy(I.yz_volatility(derived.bars_by_symbol(spark, sf)), "symbol", "date", "yz_volatility")


@query(
    "keltner",
    with_(
        B,
        true_range("t", "b", True),
        smooth("a", "t", "tr", 10, 0, wilder=True),
        smooth("m", "b", "close", 20, 0, first=True),
        recursive=True,
    )
    + f""" SELECT b.symbol, b.date, {cols(kc_upper=_full(20, "m.y + 2 * coalesce(a.y, 0)"),
      kc_middle=_full(20, "m.y"), kc_lower=_full(20, "m.y - 2 * coalesce(a.y, 0)"))}
    FROM b LEFT JOIN m USING (symbol, rn) LEFT JOIN a USING (symbol, rn)""",
)
def keltner(spark, sf):
    df = I.keltner(derived.bars_by_symbol(spark, sf), 20, 10, 2.0)
    return tidy(df, "symbol", "date", "kc_upper", "kc_middle", "kc_lower")


_DONCHIAN = f"""dc AS MATERIALIZED (SELECT symbol, date, rn, close,
  {_full(12, f"(max(high) {_w(12)} + min(low) {_w(12)} + {flat_mean('close', _w(12)[5:])}) / 3")} AS mid FROM b)"""


@query(
    "donchian",
    with_(B, _DONCHIAN) + f" SELECT symbol, date, {cols(dc_mid='mid', dc_hist='close - mid')} FROM dc",
)
def donchian(spark, sf):
    return tidy(I.donchian(derived.bars_by_symbol(spark, sf), 12), "symbol", "date", "dc_mid", "dc_hist")


@query(
    "linear_regression",
    with_(B, _DONCHIAN)
    + f""", h AS (SELECT symbol, date, rn, close - mid AS v FROM dc)
    SELECT symbol, date, {cols(linreg=_full(23, f"regr_slope(v, rn) {_w(12)} * rn + regr_intercept(v, rn) {_w(12)}"))}
    FROM h""",
)
def linear_regression(spark, sf):
    df = I.donchian(derived.bars_by_symbol(spark, sf), 12)
    df = I.linear_regression(df, "dc_hist", 12, skip=11)
    return tidy(df, "symbol", "date", "linreg")


@query(
    "expanding_mean",
    with_(B, true_range("t", "b", True), smooth("e", "t", "tr", 10, 0, wilder=True), recursive=True)
    + f""", v AS (SELECT b.symbol, b.date, b.rn, nullif(avg(coalesce(e.y, 0)) OVER (
        PARTITION BY b.symbol ORDER BY b.rn), 0) AS m FROM b LEFT JOIN e USING (symbol, rn))
    SELECT symbol, date, {cols(expanding_mean='''coalesce(last_value(m IGNORE NULLS) OVER (
      PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e-9)''')}
    FROM v""",
)
def expanding_mean(spark, sf):
    df = I.atr_zero_warmup(derived.bars_by_symbol(spark, sf), 10)
    return tidy(I.expanding_mean(df, "atr"), "symbol", "date", "expanding_mean")


@query(
    "on_balance_volume",
    with_(B)
    + f""", d AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS d FROM b)
    SELECT symbol, date, {cols(obv='''sum(coalesce(sign(d), 1) * volume) OVER (
      PARTITION BY symbol ORDER BY rn)''')} FROM d""",
)
def on_balance_volume(spark, sf):
    return tidy(I.obv(derived.bars_by_symbol(spark, sf)), "symbol", "date", "obv")


@query(
    "money_flow_index",
    with_(B)
    + f""", t AS (SELECT *, (high + low + close) / 3 AS tp FROM b),
    d AS (SELECT *, tp - lag(tp) OVER (PARTITION BY symbol ORDER BY rn) AS d FROM t),
    m AS (SELECT symbol, date, rn,
      sum(CASE WHEN d > 0 THEN tp * volume ELSE 0 END) {_w(21)} AS p,
      sum(CASE WHEN d < 0 THEN tp * volume ELSE 0 END) {_w(21)} AS n FROM d)
    SELECT symbol, date, {cols(mfi=_full(22, "CASE WHEN p + n > 0 THEN 100 * p / (p + n) ELSE 0 END"))}
    FROM m""",
)
def money_flow_index(spark, sf):
    return tidy(I.mfi(derived.bars_by_symbol(spark, sf), 21), "symbol", "date", "mfi")


@query(
    "force_index",
    with_(
        B,
        """fi AS MATERIALIZED (SELECT symbol, rn,
          coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY rn), 0) * volume AS v FROM b)""",
        smooth("e", "fi", "v", 13, 0, first=True),
        recursive=True,
    )
    + _joined("CASE WHEN rn >= 12 THEN e.y END", "efi"),
)
def force_index(spark, sf):
    return tidy(I.force_index(derived.bars_by_symbol(spark, sf)), "symbol", "date", "efi")


@query(
    "indicator_request",
    with_(B)
    + f""", m AS (SELECT *, {_full(20, f"avg(close) {_w(20)}")} AS m,
      {_full(20, f"stddev_pop(close) {_w(20)}")} AS s, {_full(50, f"avg(close) {_w(50)}")} AS s50 FROM b),
    h AS (SELECT *, max(high) {_w(14)} AS hh, min(low) {_w(14)} AS ll FROM m),
    k AS (SELECT *, {_full(14, "CASE WHEN hh - ll > 0 THEN 100 * (close - ll) / (hh - ll) ELSE 0 END")} AS k FROM h),
    sk AS (SELECT *, {_full(16, f"avg(k) {_w(3)}")} AS sk FROM k)
    SELECT symbol, date, {cols(sma="s50", bb_upper="m + 2 * s", bb_lower="m - 2 * s",
      slowd=_full(18, f"avg(sk) {_w(3)}"))} FROM sk""",
)
def indicator_request(spark, sf):
    """A chart's request: several specs at once."""
    specs = [Spec("bbands"), Spec("sma", {"timeperiod": 50}), Spec("stoch")]
    df = with_indicators(derived.bars_by_symbol(spark, sf), specs)
    return tidy(df, "symbol", "date", "sma", "bb_upper", "bb_lower", "slowd")


@query("bucketed_indicators", SQL["indicator_request"])
def bucketed_indicators(spark, sf):
    """The same request over bars that lie bucketed by symbol."""
    name = f"bars_{uuid.uuid4().hex}"
    stored.write_bucketed(derived.bars(spark, sf), name, f"{checkpoint_dir(spark)}/{name}", 16)
    specs = [Spec("bbands"), Spec("sma", {"timeperiod": 50}), Spec("stoch")]
    df = with_indicators(stored.read_bucketed(spark, name), specs)
    return tidy(df, "symbol", "date", "sma", "bb_upper", "bb_lower", "slowd")


_BOARD = """rsi macd bollinger sma ema atr_trailing vwap_highest vwap_lowest bvc stochastic
kalman_zscore yz_volatility""".split()


@query(
    "indicator_board",
    "SELECT * FROM " + " JOIN ".join(f"({SQL[n]}) AS q_{n}" + (" USING (symbol, date)" if i else "")
                                     for i, n in enumerate(_BOARD)),
)
def indicator_board(spark, sf):
    """Every indicator of a chart in one plan."""
    names = "rsi macd bbands sma ema atr_trailing vwap bvc stoch kalman_zscore yz_volatility"
    bars = derived.bars_by_symbol(spark, sf)
    df = with_indicators(bars, [Spec(n) for n in names.split()])
    return tidy(df, "symbol", "date", *[c for c in df.columns if c not in (*bars.columns, "rn")])


# --- closes with gaps ----------------------------------------------------------------------


def _gapped(spark, sf):
    """Bars without their first three closes and, for every third symbol, without the one at 40."""
    third = F.substring("symbol", 2, 12).cast("bigint") % 3 == 0
    gap = (F.col("rn") < 3) | ((F.col("rn") == 40) & third)
    return with_rn(derived.bars_by_symbol(spark, sf)).withColumn("close", F.when(~gap, F.col("close")))


def _of_all(value: str, name: str, tables: str = "LEFT JOIN e ON e.symbol = a.symbol AND e.rn = a.rn - 3") -> str:
    return f" SELECT a.symbol, a.date, {cols(**{name: value})} FROM all_b a {tables}"


@query("ema_with_gaps", with_(B_GAPS, smooth("e", "b", "close", 20), recursive=True) + _of_all("e.y", "ema"))
def ema_with_gaps(spark, sf):
    return tidy(I.ema(_gapped(spark, sf), 20), "symbol", "date", "ema")


@query(
    "rsi_with_gaps",
    with_(
        B_GAPS,
        _CHANGES,
        smooth("g", "d", "up", 14, 1, wilder=True),
        smooth("l", "d", "dn", 14, 1, wilder=True),
        recursive=True,
    )
    + _of_all(
        _rsi_value("g.y", "l.y"),
        "rsi",
        "LEFT JOIN g ON g.symbol = a.symbol AND g.rn = a.rn - 3 LEFT JOIN l ON l.symbol = a.symbol AND l.rn = a.rn - 3",
    ),
)
def rsi_with_gaps(spark, sf):
    return tidy(I.rsi(_gapped(spark, sf), 14), "symbol", "date", "rsi")


@query(
    "kalman_with_gaps",
    with_(B_GAPS, KALMAN, "e AS (SELECT symbol, rn, y FROM kf)", recursive=True) + _of_all("e.y", "kf"),
)
def kalman_with_gaps(spark, sf):
    return tidy(I.kalman(_gapped(spark, sf)), "symbol", "date", "kf")
