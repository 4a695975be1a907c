"""Crossings, entry filters and the two breakout strategies' signal columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import scalars as S
from barline.functions.series import (
    KEY,
    RN,
    along,
    rolling,
    running,
    with_rn,
)
from barline.operators import indicators as I


def shift(df: DataFrame, value: str, n: int, out: str) -> DataFrame:
    return with_rn(df).withColumn(out, F.lag(value, n).over(along()))


def crossings(df: DataFrame, pairs: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """``out: (x, y, 'above'|'below')`` flags bars where x crosses y.

    A cross needs the previous *unequal* relation to have been the opposite one: touching is not
    crossing, and an undefined value on either side starts over. Relations are coded +1 and -1,
    undefined as 0 and equal as NULL, so one "last non-null before this bar" answers it.
    """
    df = with_rn(df)
    keep = [c for c in df.columns if c not in pairs]
    signs = {}
    for o, (x, y, _) in pairs.items():
        s = S.relation(x, y)
        signs[f"_s_{o}"] = F.when(s.isNull(), F.lit(0.0)).when(s != 0, s)
    df = df.withColumns(signs)
    before = along().rowsBetween(Window.unboundedPreceding, -1)
    was = {f"_l_{o}": F.last(f"_s_{o}", ignorenulls=True).over(before) for o in pairs}
    outs = []
    for o, (_, _, side) in pairs.items():
        now = 1.0 if side == "above" else -1.0
        outs.append(S.all_of(F.col(f"_s_{o}") == now, F.col(f"_l_{o}") == -now).alias(o))
    return df.withColumns(was).select(*keep, *outs)


def first_entries(df: DataFrame, entry: str, exit_: str, out: str = "first_entry") -> DataFrame:
    """Keep an entry only when flat; an exit makes flat again; a bar carrying both flips state.

    The state before a bar is the last plain entry or exit, flipped once per both-bar since then;
    that count is the running number of both-bars less its value at the plain bar.
    """
    df = with_rn(df)
    e, x = S.safe(F.col(entry)), S.safe(F.col(exit_))
    before = along().rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "_plain": F.when(e & ~x, 1).when(x & ~e, 0),
            "_seen": F.coalesce(F.sum(F.when(e & x, 1).otherwise(0)).over(before), F.lit(0)),
        }
    )
    mark = F.when(F.col("_plain").isNotNull(), F.struct("_plain", "_seen"))
    df = df.withColumn("_mark", F.last(mark, ignorenulls=True).over(before))
    base = F.coalesce(F.col("_mark._plain"), F.lit(0))
    flips = F.col("_seen") - F.coalesce(F.col("_mark._seen"), F.lit(0))
    return df.withColumn(out, e & ((base + flips) % 2 == 0)).drop("_plain", "_seen", "_mark")


def lows_at_entry(df: DataFrame, entries: dict[str, str], low: str = "low") -> DataFrame:
    """``out: entry`` adds the low of the latest entry bar, carried forward; bar 0 never sets it
    and a missing low breaks the carry (an empty mark overwrites the last one)."""
    df = with_rn(df)
    value = F.col(low)
    out = {}
    for name, entry in entries.items():
        sets = S.safe(F.col(entry)) & (F.col(RN) > 0)
        mark = F.when(sets | value.isNull(), F.struct(value.alias("v")))
        out[name] = F.last(mark, ignorenulls=True).over(running())["v"]
    return df.withColumns(out)


def low_at_entry(df: DataFrame, entry: str, low: str = "low", out: str = "low_at_entry") -> DataFrame:
    return lows_at_entry(df, {out: entry}, low)


SQUEEZE = "Squeeze Breakout"
TTM = "Breakout TTM Version 2"

# The parameter sets each strategy is swept over.
_SWEEPS: dict[str, list[dict]] = {
    SQUEEZE: [
        {"bb_window": 10, "bb_multiplier": 1.0, "kc_window": 34, "kc_multiplier": 1.3},
        {"bb_window": 10, "bb_multiplier": 1.3, "kc_window": 30, "kc_multiplier": 1.2},
        {"bb_window": 14, "bb_multiplier": 1.1, "kc_window": 12, "kc_multiplier": 2.0},
    ],
    TTM: [
        {
            "entry_version": "v2", "bb_window": 14, "bb_multiplier": 1.4, "kc_window": 40,
            "kc_multiplier": 1.2, "atr_window": 12, "momentum_window": 12, "donichan_window": 12,
        },
        {
            "entry_version": "v1", "bb_window": 16, "bb_multiplier": 1.0, "kc_window": 40,
            "kc_multiplier": 1.2, "atr_window": 14, "momentum_window": 12, "donichan_window": 12,
        },
    ],
}


def strategy_params(name: str) -> list[dict]:
    if name not in _SWEEPS:
        raise ValueError(f"unknown strategy: {name}")
    return [dict(p) for p in _SWEEPS[name]]


def _bands(df: DataFrame, windows: set[int]) -> DataFrame:
    """Rolling mean and population deviation of the close, one pair per distinct window."""
    specs = {f"_bm{n}": ("mean", "close", n) for n in sorted(windows)}
    specs |= {f"_bs{n}": ("std_pop", "close", n) for n in sorted(windows)}
    return rolling(df, specs)


def _channel(p: dict, n_atr: int) -> tuple[Column, Column, Column, Column]:
    """(upper band, lower band, upper channel, lower channel) of one parameter set."""
    bm, bs = F.col(f"_bm{p['bb_window']}"), F.col(f"_bs{p['bb_window']}")
    off = F.lit(float(p["bb_multiplier"])) * bs
    mid = F.col(f"_mid{p['kc_window']}")
    width = F.lit(float(p["kc_multiplier"])) * F.coalesce(f"_ka{n_atr}", F.lit(0.0))
    return bm + off, bm - off, mid + width, mid - width


def squeeze_signals(
    bars: DataFrame,
    sweep: list[dict],
    atr_multiplier: float = 1.8,
    squeeze_threshold: float = 0.1,
) -> DataFrame:
    """Columns ``entry_0, exit_0, entry_1, …``, one pair per parameter set.

    Entry: close above the low-anchored VWAP and above the upper band, by crossing it while
    squeezed or by any margin while not. Squeezed: the bands lie inside a Keltner channel widened
    by a volatility-dependent threshold. Exit: close crosses below the trailing stop or below the
    low of the entry bar.

    All sets are computed side by side in one pass over the bars, sharing the anchored VWAP, the
    averages and the trailing stop, instead of one scan and shuffle per set.
    """
    ids = range(len(sweep))
    df = I.anchored_vwap(bars, "lowest")
    df = I.true_range(df, True, "_tr")
    windows = {p["kc_window"] for p in sweep}
    specs = {f"_ka{n}": I.Smooth("_tr", n, wilder=True) for n in sorted(windows | {10})}
    specs |= {f"_mid{n}": I.Smooth("close", n, from_first=True) for n in sorted(windows)}
    df = I.smooth(df, specs).withColumn("_vol", F.coalesce("_ka10", F.lit(0.0)))
    df = I.expanding_mean(df, "_vol", out="_vol_mean")
    df = _bands(df, {p["bb_window"] for p in sweep})
    df = df.withColumns({f"_bu{i}": _channel(p, p["kc_window"])[0] for i, p in enumerate(sweep)})
    df = crossings(df, {f"_up{i}": (F.col("close"), F.col(f"_bu{i}"), "above") for i in ids})
    limit = S.clip_low(F.lit(squeeze_threshold) * F.col("_vol") / F.col("_vol_mean"))
    over_vwap = S.safe(F.col("close") > F.col("vwap_lowest"))
    entries = {}
    for i, p in enumerate(sweep):
        bu, bl, ku, kl = _channel(p, p["kc_window"])
        tight = S.all_of(bu <= ku * (1.0 + limit), bl >= kl * (1.0 - limit))
        above = S.safe(S.relation(F.col("close"), bu) == 1)
        entries[f"entry_{i}"] = over_vwap & ((F.col(f"_up{i}") & tight) | (above & ~tight))
    df = df.withColumns(entries)
    df = lows_at_entry(df, {f"_low{i}": f"entry_{i}" for i in ids})
    below = {f"_x{i}": (F.col("close"), F.col(f"_low{i}"), "below") for i in ids}
    df = crossings(df, below)
    df = I.trailing_stop(
        df, "_vol", atr_multiplier, out="_trail", carry=["date", "close", *entries, *below], below="_x"
    )
    exits = [(F.col("_x") | F.col(f"_x{i}")).alias(f"exit_{i}") for i in ids]
    return df.select(KEY, "date", RN, "close", *entries, *exits)


def ttm_signals(bars: DataFrame, sweep: list[dict], atr_multiplier: float = 1.8) -> DataFrame:
    """As ``squeeze_signals`` for the other strategy.

    Entry: neither squeezed nor released, with momentum: positive (v1), or having crossed zero
    now, one or two bars ago and risen since (v2). Undefined bands count as neither. Exit, the
    same for all sets: close below the trailing stop (crossing below it is a special case).
    """
    for p in sweep:
        if p["entry_version"] not in ("v1", "v2"):
            raise ValueError(f"unknown entry version: {p['entry_version']}")
    df = I.true_range(with_rn(bars), True, "_tr")
    specs = {f"_ka{n}": I.Smooth("_tr", n, wilder=True) for n in sorted({p["atr_window"] for p in sweep})}
    specs |= {
        f"_mid{n}": I.Smooth("close", n, from_first=True)
        for n in sorted({p["kc_window"] for p in sweep})
    }
    specs["_atr"] = I.Smooth("_tr", 10, start=1, wilder=True)
    df = _bands(I.smooth(df, specs), {p["bb_window"] for p in sweep})
    for m, d in sorted({(p["momentum_window"], p["donichan_window"]) for p in sweep}):
        df = I.donchian(df, d)
        df = I.linear_regression(df, "dc_hist", m, f"_mom{m}_{d}", skip=d - 1)
        df = crossings(df, {f"_c{m}_{d}": (F.col(f"_mom{m}_{d}"), F.lit(0.0), "above")})
        df = df.withColumns(
            {
                f"_{k}{j}_{m}_{d}": F.lag(f"_{v}{m}_{d}", j).over(along())
                for j in (1, 2)
                for k, v in (("m", "mom"), ("c", "c"))
            }
        )
    entries = {}
    for i, p in enumerate(sweep):
        bu, bl, ku, kl = _channel(p, p["atr_window"])
        quiet = ~S.all_of(bu < ku, bl > kl) & ~S.all_of(bu > ku, bl < kl)
        key = f"{p['momentum_window']}_{p['donichan_window']}"
        mom = F.col(f"_mom{key}")
        if p["entry_version"] == "v1":
            go = S.safe(mom > 0)
        else:
            go = S.any_of(
                F.col(f"_c{key}"),
                (mom > F.col(f"_m1_{key}")) & F.col(f"_c1_{key}"),
                (mom > F.col(f"_m2_{key}")) & F.col(f"_c2_{key}"),
            )
        entries[f"entry_{i}"] = quiet & go
    df = df.withColumns(entries)
    df = I.trailing_stop(df, "_atr", atr_multiplier, out="_trail", carry=["date", "close", *entries])
    gone = S.safe(F.col("close") < F.col("_trail"))
    exits = [gone.alias(f"exit_{i}") for i in range(len(sweep))]
    return df.select(KEY, "date", RN, "close", *entries, *exits)
