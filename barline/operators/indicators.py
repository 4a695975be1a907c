"""Technical indicators over daily bars, every symbol at once.

Each function adds columns to a bars table. Warm-up cells are NULL unless the docstring says 0.
All recurrences go through ``series.decayed_sums`` but the trailing stop, a fold over sorted lists.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import scalars as S
from barline.functions.series import (
    KEY,
    RN,
    along,
    backward,
    decayed_sums,
    fill_forward,
    full_window,
    rolling,
    running,
    sliding_argextremes,
    with_rn,
)


# --- moving averages ---------------------------------------------------------------------


def sma(bars: DataFrame, n: int = 20, price: str = "close", out: str = "sma") -> DataFrame:
    return rolling(bars, {out: ("mean", price, n)})


@dataclass(frozen=True)
class Smooth:
    """One exponential average of ``value``. Positions count from the first value that is not null;
    after a later null the average stays undefined. The first ``n`` positions from ``start`` seed it
    with their mean, or, with ``from_first``, its first value does; ``wilder`` decays by (n-1)/n
    instead of (n-1)/(n+1). Defined from position start+n-1 on."""

    value: str
    n: int
    start: int = 0
    wilder: bool = False
    from_first: bool = False

    @property
    def alpha(self) -> float:
        return 1.0 / self.n if self.wilder else 2.0 / (self.n + 1)

    @property
    def first(self) -> int:
        return self.start + self.n - 1

    def terms(self, at: Column) -> Column:
        """The addends b[t] of y[t] = (1-alpha)·y[t-1] + b[t] by position ``at``.

        A seed bar's share x/n is raised by the decay it will have gone through when the seed is
        complete, so that the sum there is the plain mean; no separate window is needed for it.
        """
        x = F.col(self.value)
        later = x * F.lit(self.alpha)
        if self.from_first:
            return F.when(at == self.start, x).when(at > self.start, later)
        raised = F.pow(F.lit(1.0 - self.alpha), (at - self.first).cast("double"))
        share = x / F.lit(float(self.n)) * raised
        return F.when(at.between(self.start, self.first), share).when(at > self.first, later)


def with_positions(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """``out: value``: bars since the first one where the value is not null; NULL before it and
    from the first null after it on. Both windows run in the order the rows are in."""
    df = with_rn(df)
    x = {out: F.col(v) for out, v in values.items()}
    df = df.withColumns(
        {f"_f{out}": F.min(F.when(v.isNotNull(), F.col(RN))).over(running()) for out, v in x.items()}
        | {f"_n{out}": F.count(v).over(running()) for out, v in x.items()}
    )
    at = {out: F.col(RN) - F.col(f"_f{out}") for out in values}
    whole = {out: F.when(at[out] + 1 == F.col(f"_n{out}"), at[out]) for out in values}
    return df.withColumns(whole).drop(*[f"_{k}{out}" for out in values for k in "fn"])


def smooth(bars: DataFrame, specs: dict[str, Smooth]) -> DataFrame:
    """Any number of exponential averages in one go: all of them share the windows."""
    at = {s.value: f"_at_{s.value}" for s in specs.values()}
    df = with_positions(bars, {name: value for value, name in at.items()})
    df = df.withColumns({f"_b_{out}": s.terms(F.col(at[s.value])) for out, s in specs.items()})
    df = decayed_sums(df, {f"_y_{out}": (f"_b_{out}", 1.0 - s.alpha) for out, s in specs.items()})
    shown = {
        out: F.when(F.col(at[s.value]) >= s.first, F.col(f"_y_{out}")) for out, s in specs.items()
    }
    return df.withColumns(shown).drop(*at.values(), *[f"_{k}_{out}" for out in specs for k in "by"])


def emas(bars: DataFrame, spans: dict[str, int], price: str = "close") -> DataFrame:
    """Exponential averages seeded with the simple mean of the first n bars."""
    return smooth(bars, {out: Smooth(price, n) for out, n in spans.items()})


def ema(bars: DataFrame, n: int = 20, price: str = "close", out: str = "ema") -> DataFrame:
    return emas(bars, {out: n}, price)


# --- momentum ----------------------------------------------------------------------------


def with_moves(bars: DataFrame, price: str = "close") -> DataFrame:
    """Upward and downward part of each change: ``_up``, ``_dn``; NULL where there is none."""
    df = with_rn(bars).withColumn("_d", F.col(price) - F.lag(price).over(along()))
    moves = {"_up": S.clip_low(F.col("_d")), "_dn": S.clip_low(-F.col("_d"))}
    return df.withColumns(moves).drop("_d")


def rsi_specs(lengths: dict[str, int]) -> dict[str, Smooth]:
    specs = {}
    for out, n in lengths.items():
        specs[f"_g_{out}"] = Smooth("_up", n, wilder=True)
        specs[f"_l_{out}"] = Smooth("_dn", n, wilder=True)
    return specs


def rsi_values(df: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """The RSIs from their smoothed moves, whose columns go."""
    values = {}
    for out in lengths:
        gain, total = F.col(f"_g_{out}"), F.col(f"_g_{out}") + F.col(f"_l_{out}")
        some = F.when(total > 0, 100.0 * gain / total)
        values[out] = some.when(total.isNotNull(), F.lit(0.0))
    return df.withColumns(values).drop("_up", "_dn", *rsi_specs(lengths))


def rsis(bars: DataFrame, lengths: dict[str, int], price: str = "close") -> DataFrame:
    """100·gain/(gain+loss) of Wilder averages, 0 when both are 0; first value at bar n."""
    return rsi_values(smooth(with_moves(bars, price), rsi_specs(lengths)), lengths)


def rsi(bars: DataFrame, n: int = 14, price: str = "close", out: str = "rsi") -> DataFrame:
    return rsis(bars, {out: n}, price)


def rsi_pair(bars: DataFrame, n: int = 14) -> DataFrame:
    """The requested RSI together with the fixed 5-bar one."""
    return rsis(bars, {"rsi": n, "rsi_5": 5})


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, macd_signal, macd_hist. Both averages start together at bar slow-1; all outputs are
    shown once the signal exists, from bar slow+signal-2."""
    df = smooth(
        bars, {"_slow": Smooth("close", slow), "_fast": Smooth("close", fast, start=slow - fast)}
    )
    df = df.withColumn("_line", F.col("_fast") - F.col("_slow"))
    df = smooth(df, {"_sig": Smooth("_line", signal)})
    shown = F.col("_sig").isNotNull()
    return df.withColumns(
        {
            "macd": F.when(shown, F.col("_line")),
            "macd_signal": F.col("_sig"),
            "macd_hist": F.col("_line") - F.col("_sig"),
        }
    ).drop("_slow", "_fast", "_line", "_sig")


def stochastic(bars: DataFrame, fast_k: int = 14, slow_k: int = 3, slow_d: int = 3) -> DataFrame:
    """slowk, slowd: two simple averages of the raw position in the high-low range, 0 for an empty
    range; both shown from the bar where slowd exists."""
    df = rolling(bars, {"_hh": ("max", "high", fast_k), "_ll": ("min", "low", fast_k)})
    span = F.col("_hh") - F.col("_ll")
    raw = F.when(span > 0, 100.0 * (F.col("close") - F.col("_ll")) / span)
    df = df.withColumn("_k", raw.when(span.isNotNull(), F.lit(0.0)))
    df = rolling(df, {"_sk": ("mean", "_k", slow_k)})
    df = rolling(df, {"slowd": ("mean", "_sk", slow_d)})
    shown = F.when(F.col("slowd").isNotNull(), F.col("_sk"))
    return df.withColumn("slowk", shown).drop("_hh", "_ll", "_k", "_sk")


# --- bands and ranges --------------------------------------------------------------------


def bollinger(
    bars: DataFrame, n: int = 20, up: float = 2.0, down: float = 2.0, prefix: str = "bb"
) -> DataFrame:
    """Simple mean plus and minus a multiple of the population deviation."""
    middle = f"{prefix}_middle"
    df = rolling(bars, {middle: ("mean", "close", n), "_sd": ("std_pop", "close", n)})
    return df.withColumns(
        {
            f"{prefix}_upper": F.col(middle) + F.lit(float(up)) * F.col("_sd"),
            f"{prefix}_lower": F.col(middle) - F.lit(float(down)) * F.col("_sd"),
        }
    ).drop("_sd")


def true_range(bars: DataFrame, first_bar: bool, out: str = "tr") -> DataFrame:
    """max(high-low, |high-prev close|, |low-prev close|); on bar 0 high-low or nothing."""
    df = with_rn(bars)
    prev = F.lag("close").over(along())
    df = df.withColumn("_pc", prev)
    spread = F.col("high") - F.col("low")
    jumps = F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc"))
    known = F.col("_pc").isNotNull() & spread.isNotNull()
    value = F.when(known, F.greatest(spread, *jumps))
    if first_bar:
        value = F.when(F.col(RN) == 0, spread).otherwise(value)
    return df.withColumn(out, value).drop("_pc")


def atr(bars: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    """Average true range; ranges count from bar 1, first value at bar n."""
    df = true_range(bars, False, "_tr")
    return smooth(df, {out: Smooth("_tr", n, wilder=True)}).drop("_tr")


def atr_zero_warmup(bars: DataFrame, n: int = 10, out: str = "atr") -> DataFrame:
    """The other common seeding: ranges count from bar 0, first value at bar n-1, 0 before."""
    df = true_range(bars, True, "_tr")
    df = smooth(df, {out: Smooth("_tr", n, wilder=True)})
    return df.withColumn(out, F.coalesce(out, F.lit(0.0))).drop("_tr")


def keltner(
    bars: DataFrame, n: int = 20, n_atr: int = 10, mult: float = 2.0, prefix: str = "kc"
) -> DataFrame:
    """Exponential average from the first close, plus and minus a multiple of the ATR."""
    df = true_range(bars, True, "_tr")
    middle = f"{prefix}_middle"
    df = smooth(
        df,
        {
            middle: Smooth("close", n, from_first=True),
            "_ka": Smooth("_tr", n_atr, wilder=True),
        },
    )
    width = F.lit(mult) * F.coalesce("_ka", F.lit(0.0))
    return df.withColumns(
        {f"{prefix}_upper": F.col(middle) + width, f"{prefix}_lower": F.col(middle) - width}
    ).drop("_tr", "_ka")


def donchian(bars: DataFrame, n: int = 12) -> DataFrame:
    """dc_mid = (highest high + lowest low + mean close)/3 and the close's distance to it."""
    df = rolling(
        bars, {"_h": ("max", "high", n), "_l": ("min", "low", n), "_c": ("mean", "close", n)}
    )
    mid = (F.col("_h") + F.col("_l") + F.col("_c")) / 3.0
    df = df.withColumn("dc_mid", mid).withColumn("dc_hist", F.col("close") - F.col("dc_mid"))
    return df.drop("_h", "_l", "_c")


def linear_regression(
    df: DataFrame, value: str, n: int, out: str = "linreg", skip: int = 0
) -> DataFrame:
    """End point of the least-squares line through the last n values; ``skip`` leading bars of
    the input are warm-up.

    On equally spaced points the end point is a fixed weighting of the values, 2(3i - n - 1) /
    (n(n+1)) for the i-th oldest, so n offsets replace two regression aggregates per frame.
    """
    df = with_rn(df)
    total = None
    for i in range(1, n + 1):
        x = F.lag(value, n - i).over(along()) if i < n else F.col(value)
        term = F.lit(2.0 * (3 * i - n - 1) / (n * (n + 1))) * x
        total = term if total is None else total + term
    return df.withColumn("_e", total).withColumn(out, full_window(n + skip, F.col("_e"))).drop("_e")


def expanding_mean(df: DataFrame, value: str, out: str = "expanding_mean") -> DataFrame:
    """Mean of all bars so far; zeros count, then a zero mean takes the last non-zero mean and
    finally 1e-9, so it can divide."""
    df = with_rn(df).withColumn("_m", S.zero_to_null(F.avg(value).over(running())))
    return df.withColumn(out, F.coalesce(fill_forward("_m"), F.lit(1e-9))).drop("_m")


# --- returns -----------------------------------------------------------------------------


def simple_return(bars: DataFrame, out: str = "ret", order: str = "date") -> DataFrame:
    prev = F.lag("close").over(along(order=order))
    return bars.withColumn(out, S.ratio(F.col("close"), prev) - 1.0)


def log_return(bars: DataFrame, out: str = "log_return") -> DataFrame:
    df = with_rn(bars)
    q = S.ratio(F.col("close"), F.lag("close").over(along()))
    df = df.withColumn("_q", q)
    return df.withColumn(out, F.when(F.col("_q") > 0, F.ln("_q"))).drop("_q")


def zscores(df: DataFrame, specs: dict[str, tuple[str, int]]) -> DataFrame:
    """``out: (value, n)``: (x - mean)/sample deviation over the last n bars; NULL while warming up
    or flat."""
    need = {}
    for out, (value, n) in specs.items():
        need[f"_m_{out}"] = ("mean", value, n)
        need[f"_d_{out}"] = ("std_samp", value, n)
    df = rolling(df, need)
    z = {
        out: (F.col(value) - F.col(f"_m_{out}")) / S.zero_to_null(F.col(f"_d_{out}"))
        for out, (value, _) in specs.items()
    }
    return df.withColumns(z).drop(*need)


def zscore(df: DataFrame, value: str, n: int, out: str) -> DataFrame:
    return zscores(df, {out: (value, n)})


def _squared_logs(bars: DataFrame) -> DataFrame:
    """Squared logs of open to previous close, close to open and high to low, and the range term
    built from them."""
    df = with_rn(bars).withColumn("_pc", F.lag("close").over(along()))

    def sq_log(a: str, b: str) -> Column:
        q = S.ratio(F.col(a), F.col(b))
        log = F.ln(F.when(q > 0, q))
        return log * log

    df = df.withColumns(
        {"_o": sq_log("open", "_pc"), "_c": sq_log("close", "open"), "_h": sq_log("high", "low")}
    )
    rs = 0.5 * F.col("_h") - F.lit(2.0 * math.log(2.0) - 1.0) * (F.col("_c") + F.col("_o"))
    return df.withColumn("_rs", rs).drop("_pc", "_h")


def yz_volatilities(bars: DataFrame, windows: dict[str, int], periods: int = 252) -> DataFrame:
    """Yang-Zhang volatility per window, annualised; 0 until that many bars with a previous close
    exist."""
    df = _squared_logs(bars)
    need = {
        f"_m{c}{w}": ("mean", c, w) for w in sorted(set(windows.values())) for c in ("_o", "_c", "_rs")
    }
    df = rolling(df, need)
    out = {}
    for name, w in windows.items():
        k = 0.34 / (1.34 + (w + 1) / (w - 1))
        mo, mc, mr = (F.col(f"_m{c}{w}") for c in ("_o", "_c", "_rs"))
        var = mo + F.lit(k) * mc + F.lit(1.0 - k) * S.clip_low(mr)
        vol = F.sqrt(S.clip_low(var)) * F.lit(math.sqrt(periods))
        out[name] = F.coalesce(vol, F.lit(0.0))
    return df.withColumns(out).drop("_o", "_c", "_rs", *need)


def yz_volatility(
    bars: DataFrame, window: int = 30, periods: int = 252, out: str = "yz_volatility"
) -> DataFrame:
    return yz_volatilities(bars, {out: window}, periods)


# --- Kalman filter -----------------------------------------------------------------------

_SETTLED = 256  # the gain changes by less than one ulp well before this bar


@lru_cache(maxsize=8)
def _kalman_gains(obs_var: float, step_var: float) -> tuple[tuple[float, ...], float]:
    """Gains of a scalar random-walk filter. They follow from the variances alone, not the data."""
    gains, p = [], 1.0
    for t in range(_SETTLED):
        prior = p if t == 0 else p + step_var
        gains.append(prior / (prior + obs_var))
        p = (1.0 - gains[-1]) * prior
    return tuple(gains), gains[-1]


def kalman(bars: DataFrame, price: str = "close", out: str = "kf") -> DataFrame:
    """Filtered (not smoothed) price of a 1-D random walk: start mean 0 and variance 1,
    observation variance 1, step variance 0.01.

    y[t] = (1-K[t])·y[t-1] + K[t]·x[t]. While K still moves, y = D·Σ K·x/D with D the running
    product of (1-K), a table of known numbers; after that it is a constant-decay sum.
    Steps count from the first price; after a later missing one the filter stays undefined.
    """
    gains, settled = _kalman_gains(1.0, 0.01)
    decay = [1.0]
    for g in gains[1:]:
        decay.append(decay[-1] * (1.0 - g))
    df = with_positions(bars, {"_at": price})
    step = F.col("_at")
    early = step < _SETTLED
    place = F.least(step, F.lit(_SETTLED - 1)) + 1
    weight = F.element_at(F.array(*[F.lit(g / d) for g, d in zip(gains, decay)]), place)
    scale = F.element_at(F.array(*[F.lit(d) for d in decay]), place)
    df = df.withColumn("_wx", F.when(early, F.col(price) * weight)).withColumn("_d", scale)
    df = df.withColumn("_head", F.sum("_wx").over(running()) * F.col("_d"))
    b = F.when(step == _SETTLED - 1, F.col("_head")).when(
        step >= _SETTLED, F.col(price) * F.lit(settled)
    )
    df = decayed_sums(df.withColumn("_b", b), {"_tail": ("_b", 1.0 - settled)})
    value = F.when(early, F.col("_head")).when(step >= _SETTLED, F.col("_tail"))
    return df.withColumn(out, value).drop("_at", "_wx", "_d", "_head", "_b", "_tail")


def kalman_zscore(bars: DataFrame, window: int = 20, out: str = "kalman_zscore") -> DataFrame:
    """Z-score of the filtered price against its own trailing window, 0 while warming up."""
    df = kalman(bars, out="_kf")
    df = zscore(df, "_kf", window, out)
    return df.withColumn(out, F.coalesce(out, F.lit(0.0))).drop("_kf")


# --- decayed volume balance --------------------------------------------------------------


def bvc(bars: DataFrame, window: int = 20, kappa: float = 0.1, out: str = "bvc") -> DataFrame:
    """Decayed bulk volume classification: volume is signed by the Student-t probability
    (df = 0.25) of the return scaled by the deviation of the *previous* ``window`` returns, and
    accumulated with decay e^-kappa; in units of 100,000."""
    df = log_return(bars, "_r").withColumn("_r", F.coalesce("_r", F.lit(0.0)))
    before = along().rowsBetween(-window, -1)
    df = df.withColumn("_sg", F.stddev_pop("_r").over(before))
    df = df.withColumn("_z", F.col("_r") / S.zero_to_null(F.col("_sg")))
    df = df.withColumn("_z2", F.col("_z") * F.col("_z"))
    label = F.signum("_z") * S.student_t_balance(F.col("_z2"), 0.25)
    df = df.withColumn(
        "_b", F.when(F.col(RN) >= window, F.col("volume") * F.coalesce(label, F.lit(0.0)))
    )
    df = decayed_sums(df, {"_acc": ("_b", math.exp(-kappa))})
    df = df.withColumn(out, full_window(window + 1, F.col("_acc") / 100000.0))
    return df.drop("_r", "_sg", "_z", "_z2", "_b", "_acc")


# --- anchored VWAP -----------------------------------------------------------------------


def anchored_vwaps(
    bars: DataFrame, outs: dict[str, str], window: int = 200
) -> DataFrame:
    """``out: side`` adds the volume-weighted typical price since the latest window extreme of the
    close, 'highest' or 'lowest'. All sides share the sorts.

    Anchors are the bars that are the first extreme of any trailing window from the first bar i0
    that is its own window's extreme. An anchor may be confirmed by up to window-1 later bars, so
    this looks ahead, as does the fill: bars before i0 take the first value, later gaps the next.

    The trailing extreme's index never moves back, so each anchor shows up first on one row. That
    row also emits a marker at the anchor's own position; after one local re-sort a running
    maximum of markers gives each bar its anchor, without a join.
    """
    df = with_rn(bars)
    keep = [c for c in df.columns if c not in outs]
    ids = range(len(outs))
    df = sliding_argextremes(df, "close", window, {f"_a{i}": s for i, s in enumerate(outs.values())})
    started = {f"_on{i}": F.max(F.when(F.col(f"_a{i}") == F.col(RN), 1)).over(running()) for i in ids}
    df = df.withColumns(started | {f"_pa{i}": F.lag(f"_a{i}").over(along()) for i in ids})
    none = F.lit(None).cast("int")
    marks = [F.array(F.struct(none.alias("side"), none.alias("at")))]
    for i in ids:
        news = F.col(f"_on{i}").isNotNull() & ~F.col(f"_a{i}").eqNullSafe(F.col(f"_pa{i}"))
        mark = F.array(F.struct(F.lit(i).alias("side"), F.col(f"_a{i}").cast("int").alias("at")))
        marks.append(F.when(news, mark).otherwise(F.slice(mark, 1, 0)))
    df = df.withColumn("_m", F.explode(F.concat(*marks)))
    df = df.withColumn("_at", F.coalesce("_m.at", RN)).withColumn("_late", F.col("_m.at").isNull())
    w = Window.partitionBy(KEY).orderBy("_at", "_late").rowsBetween(Window.unboundedPreceding, 0)
    latest = {f"_anchor{i}": F.max(F.when(F.col("_m.side") == i, F.col("_m.at"))).over(w) for i in ids}
    df = df.withColumns(latest).where(F.col("_late"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    for i in ids:
        seg = Window.partitionBy(KEY, f"_anchor{i}").orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"_pv{i}": F.sum(typical * F.col("volume")).over(seg), f"_v{i}": F.sum("volume").over(seg)})
    df = df.withColumns(
        {
            f"_x{i}": F.when(F.col(f"_anchor{i}").isNotNull(), S.ratio(F.col(f"_pv{i}"), F.col(f"_v{i}")))
            for i in ids
        }
    )
    df = df.withColumns({f"_next{i}": F.last(f"_x{i}", ignorenulls=True).over(backward()) for i in ids})
    filled = {o: F.coalesce(f"_next{i}", fill_forward(f"_x{i}")) for i, o in enumerate(outs)}
    return df.withColumns(filled).select(*keep, *outs)


def anchored_vwap(
    bars: DataFrame, side: str = "highest", window: int = 200, out: str | None = None
) -> DataFrame:
    return anchored_vwaps(bars, {out or f"vwap_{side}": side}, window)


# --- trailing stop -----------------------------------------------------------------------


#: Bars that one inner fold of the trailing stop covers: appending to a list costs its length.
STOP_PAGE = 48


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once. The result is copied in depth, so it should be small."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _stop_step(state: Column, bar: Column, multiplier: float, tie: float) -> Column:
    """The stop's state after one more bar. Nulls stand for what is undefined; no comparison with one holds."""
    src, stop, prev = bar["_src"], state["_stop"], state["prev"]
    gap = bar["_gap"] * F.lit(multiplier)
    moved = (
        F.when(~state["begun"] | src.isNull(), F.lit(None).cast("double"))
        .when((src > stop) & (prev > stop), F.greatest(stop, src - gap))
        .when((src < stop) & (prev < stop), F.least(stop, src + gap))
        .when(src > stop, src - gap)
        .otherwise(src + gap)
    )

    def after(t: Column) -> Column:
        known = src.isNotNull() & t.isNotNull()
        level = F.abs(src - t) <= F.lit(tie) * F.greatest(F.abs(src), F.abs(t))
        crossed = known & ~level & state["above"] & (src < t)
        above = F.when(~known, F.lit(False)).when(level, state["above"]).otherwise(src > t)
        return _stop_state(F.lit(True), src, t, above, F.coalesce(crossed, F.lit(False)))

    return _let(moved, after)


def _stop_state(begun: Column, prev: Column, stop: Column, above: Column, below: Column) -> Column:
    return F.struct(
        begun.alias("begun"), prev.alias("prev"), stop.alias("_stop"), above.alias("above"), below.alias("_below")
    )


def trailing_stop(
    df: DataFrame,
    atr_col: str,
    multiplier: float = 1.8,
    out: str = "atr_trailing",
    carry: list[str] | None = None,
    by: str = KEY,
    below: str | None = None,
) -> DataFrame:
    """ATR trailing stop: follows the close at ``multiplier``·ATR, flips side when crossed. ``below``
    names a flag for the bars where the close crosses below it: its last side other than a tie was above, and
    nothing was undefined since.

    The only recurrence here that is not linear, so it cannot be a decayed sum. It is a fold in the JVM: a key's
    bars, which the calendar bounds, form one sorted list; pages of it are folded one after the other, each from the
    last state of the page before it. The states themselves are the list that is built: a state that held the list
    would be copied with it at each bar. After the ATR's windows the lists need no new shuffle.
    ``carry`` names the columns to keep (all by default); fewer means smaller lists.
    """
    df = with_rn(df)
    carry = [c for c in (carry or df.columns) if c not in (by, RN, out)]
    bar = F.struct(
        F.col(RN),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
        S.nan_to_null(F.col("close").cast("double")).alias("_src"),
        S.nan_to_null(F.col(atr_col).cast("double")).alias("_gap"),
    )
    bars = df.groupBy(by).agg(F.collect_list(bar).alias("_all"))
    # A key's bar numbers differ, so nothing behind them decides the order.
    bars = bars.select(by, F.sort_array("_all").alias("_all"))
    pages = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / STOP_PAGE).cast("int")),
        lambda k: F.slice("_all", k * STOP_PAGE + 1, F.lit(STOP_PAGE)),
    )
    nothing = F.lit(None).cast("double")

    def step(states: Column, one: Column) -> Column:
        new = _let(F.element_at(states, -1), lambda now: _stop_step(now, one, multiplier, S.TIE))
        return F.concat(states, F.array(new))

    def fold(states: Column, page: Column) -> Column:
        # from the last state on; the list's first one is that state again
        made = F.aggregate(page, F.array(F.element_at(states, -1)), step)
        return F.concat(states, F.slice(made, F.lit(2), F.size(page)))

    begin = F.array(_stop_state(F.lit(False), nothing, nothing, F.lit(False), F.lit(False)))
    made = F.aggregate(pages, begin, fold, lambda states: F.slice(states, F.lit(2), F.size("_all")))
    done = bars.select(by, F.explode(F.arrays_zip(F.col("_all").alias("b"), made.alias("s"))).alias("_x"))
    kept = [F.col("_x.b")[f"_c{i}"].alias(c) for i, c in enumerate(carry)]
    flags = [F.col("_x.s._below").alias(below)] if below else []
    return done.select(by, F.col("_x.b")[RN].alias(RN), *kept, *flags, F.col("_x.s._stop").alias(out))


def atr_trailing(bars: DataFrame, n: int = 10, multiplier: float = 1.8) -> DataFrame:
    df = atr(bars, n, out="_atr")
    carry = [c for c in df.columns if c != "_atr"]
    return trailing_stop(df, "_atr", multiplier, carry=carry)


# --- volume and money flow ---------------------------------------------------------------


def obv(bars: DataFrame, out: str = "obv") -> DataFrame:
    """On-balance volume: bar 0 counts its volume, then volume signed by the close's change."""
    df = with_rn(bars).withColumn("_d", F.col("close") - F.lag("close").over(along()))
    flow = F.coalesce(F.signum("_d"), F.lit(1.0)) * F.col("volume")
    return df.withColumn("_f", flow).withColumn(out, F.sum("_f").over(running())).drop("_d", "_f")


def mfi(bars: DataFrame, n: int = 21, out: str = "mfi") -> DataFrame:
    """Money flow index over n typical-price changes, first value at bar n."""
    df = with_rn(bars).withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    df = df.withColumn("_dt", F.col("_tp") - F.lag("_tp").over(along()))
    money = F.col("_tp") * F.col("volume")
    df = df.withColumns(
        {
            "_p": F.when(F.col("_dt") > 0, money).otherwise(F.lit(0.0)),
            "_n": F.when(F.col("_dt") < 0, money).otherwise(F.lit(0.0)),
        }
    )
    df = rolling(df, {"_sp": ("sum", "_p", n), "_sn": ("sum", "_n", n)})
    total = F.col("_sp") + F.col("_sn")
    value = F.when(total > 0, 100.0 * F.col("_sp") / total).otherwise(F.lit(0.0))
    return df.withColumn(out, full_window(n + 1, value)).drop("_tp", "_dt", "_p", "_n", "_sp", "_sn")


def with_force(bars: DataFrame) -> DataFrame:
    """Change times volume: ``_fi``."""
    df = with_rn(bars)
    d = F.col("close") - F.lag("close").over(along())
    return df.withColumn("_fi", F.coalesce(d, F.lit(0.0)) * F.col("volume"))


def force_index(bars: DataFrame, n: int = 13, out: str = "efi") -> DataFrame:
    """Elder's force index: exponential average (from the first value) of change times volume."""
    return smooth(with_force(bars), {out: Smooth("_fi", n, from_first=True)}).drop("_fi")
