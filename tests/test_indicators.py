import math

import pytest
from helpers import DAY0, bars, closes, column, ohlcv, same, walk
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.functions import scalars as S
from barline.functions import series
from barline.functions.series import with_rn
from barline.operators import indicators as I
from barline.plans.indicators import Spec, with_indicators


def ema_loop(x, n, first=False):
    a, y, out = 2 / (n + 1), None, []
    for i, v in enumerate(x):
        if first:
            y = v if i == 0 else y + a * (v - y)
        elif i == n - 1:
            y = sum(x[:n]) / n
        elif i >= n:
            y = y + a * (v - y)
        out.append(y if i >= n - 1 else None)
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 20])
def test_ema_over_many_blocks(spark, n):
    """n = 2 decays fastest: its blocks hold about a thousand bars, so 3,500 bars span several."""
    x = walk(3500, n)
    got = column(I.ema(closes(spark, {"A": x}), n), "ema")
    same(got, ema_loop(x, n))


def test_blocks_carry_everything(spark, monkeypatch):
    """Tiny blocks make the carry do most of the work, with many lags."""
    monkeypatch.setattr(series, "_block_rows", lambda r: 7)
    x = walk(120, 3)
    df = I.smooth(
        closes(spark, {"A": x, "B": x[::-1]}), {"a": I.Smooth("close", 3, from_first=True)}
    )
    same(column(df, "a", "A"), ema_loop(x, 3, first=True))
    same(column(df, "a", "B"), ema_loop(x[::-1], 3, first=True))


def test_far_apart_decays_split_into_groups(spark):
    x = walk(900, 5)
    df = I.emas(closes(spark, {"A": x}), {"fast": 2, "slow": 400})
    same(column(df, "fast"), ema_loop(x, 2))
    same(column(df, "slow"), ema_loop(x, 400))


def rsi_loop(x, n):
    out, g, l = [], 0.0, 0.0
    for i in range(len(x)):
        d = x[i] - x[i - 1] if i else 0.0
        up, dn = max(d, 0.0), max(-d, 0.0)
        if 1 <= i <= n:
            g, l = g + up / n, l + dn / n
        elif i > n:
            g, l = (g * (n - 1) + up) / n, (l * (n - 1) + dn) / n
        out.append(None if i < n else 0.0 if g + l == 0 else 100 * g / (g + l))
    return out


@pytest.mark.parametrize(
    "x", [walk(60, 8), [5.0] * 30, list(range(1, 40)), list(range(40, 1, -1))], ids=str
)
def test_rsi(spark, x):
    got = column(I.rsi(closes(spark, {"A": x}), 14), "rsi")
    same(got, rsi_loop([float(v) for v in x], 14), 1e-7)
    assert all(0 <= v <= 100.0000001 for v in got if v is not None)


def test_macd_warmup_and_identity(spark):
    df = I.macd(closes(spark, {"A": walk(80, 2)}))
    rows = df.orderBy("date").collect()
    assert [r.macd is None for r in rows].count(True) == 26 + 9 - 2
    for r in rows[33:]:
        assert math.isclose(r.macd - r.macd_signal, r.macd_hist, abs_tol=1e-9)


def test_kalman(spark):
    x = walk(700, 4)
    m, p, want = 0.0, 1.0, []
    for t, z in enumerate(x):
        prior = p if t == 0 else p + 0.01
        k = prior / (prior + 1.0)
        m, p = m + k * (z - m), (1 - k) * prior
        want.append(m)
    same(column(I.kalman(closes(spark, {"A": x})), "kf"), want)


def test_bollinger_is_exact_on_flat_prices(spark):
    rows = I.bollinger(closes(spark, {"A": [0.1] * 40}), 7).where("rn >= 6").collect()
    assert all(r.bb_upper == r.bb_lower == r.bb_middle == 0.1 for r in rows)
    assert I.bollinger(closes(spark, {"A": [1.0] * 5}), 20).where("bb_middle is not null").count() == 0


@pytest.mark.parametrize("n", [5, 12, 13, 30])
def test_rolling_short_and_long_frames_agree(spark, n):
    x = walk(90, n)
    df = series.rolling(
        closes(spark, {"A": x}),
        {k: (k, "close", n) for k in ("mean", "max", "min", "std_pop", "std_samp", "sum")},
    )
    rows = df.orderBy("date").collect()
    for i, r in enumerate(rows):
        w = x[max(0, i - n + 1) : i + 1]
        if len(w) < n:
            assert r["mean"] is None and r["std_pop"] is None
            continue
        m = sum(w) / n
        ss = sum((v - m) ** 2 for v in w)
        same(
            [r["mean"], r["max"], r["min"], r["sum"], r["std_pop"], r["std_samp"]],
            [m, max(w), min(w), sum(w), math.sqrt(ss / n), math.sqrt(ss / (n - 1))],
            1e-8,
        )


def test_linear_regression_end_point(spark):
    x = walk(60, 9)
    got = column(I.linear_regression(closes(spark, {"A": x}), "close", 12), "linreg")
    want = []
    for i in range(len(x)):
        if i < 11:
            want.append(None)
            continue
        w = x[i - 11 : i + 1]
        mx, my = 5.5, sum(w) / 12
        slope = sum((k - mx) * (v - my) for k, v in enumerate(w)) / sum((k - mx) ** 2 for k in range(12))
        want.append(my + slope * (11 - mx))
    same(got, want, 1e-8)


def vwap_loop(rows, side, window):
    """Rewrites the suffix from every anchor, then fills."""
    n = len(rows)
    out, seen = [None] * n, set()
    for i in range(window - 1, n):
        w = [r[3] for r in rows[i - window + 1 : i + 1]]
        best = max(w) if side == "highest" else min(w)
        a = i - window + 1 + w.index(best)
        seen.add(a)
        if i in seen or any(v is not None for v in out[:i]):
            pv = vol = 0.0
            for t in range(a, n):
                _, h, l, c, v = rows[t]
                pv, vol = pv + (h + l + c) / 3 * v, vol + v
                out[t] = pv / vol if vol else None
    last = None
    for t in range(n - 1, -1, -1):
        if out[t] is None:
            out[t] = last
        last = out[t]
    for t in range(1, n):
        if out[t] is None:
            out[t] = out[t - 1]
    return out


@pytest.mark.parametrize("side", ["highest", "lowest"])
def test_anchored_vwap(spark, side):
    series_ = {f"S{k}": ohlcv(10 + 7 * k, k, ties=k % 2 == 0) for k in range(12)}
    df = I.anchored_vwap(bars(spark, series_), side, 8)
    for sym, rows in series_.items():
        same(column(df, f"vwap_{side}", sym), vwap_loop(rows, side, 8), 1e-8)


def test_anchored_vwap_without_volume(spark):
    rows = [(1, 1, 1, c, 0) for c in (3, 2, 1, 2, 3, 4, 5)]
    assert set(column(I.anchored_vwap(bars(spark, {"A": rows}), "lowest", 3), "vwap_lowest")) == {None}


def stop_loop(close, gap):
    out = [None]
    for i in range(1, len(close)):
        s, p, t, d = close[i], close[i - 1], out[-1], gap[i]
        if s is None or d is None:
            out.append(None)
        elif t is None or p is None:
            out.append(s - d if t is not None and s > t else s + d)
        elif s > t and p > t:
            out.append(max(t, s - d))
        elif s < t and p < t:
            out.append(min(t, s + d))
        else:
            out.append(s - d if s > t else s + d)
    return out


@pytest.mark.parametrize("page", [7, 128])
def test_trailing_stop_across_pages(spark, monkeypatch, page):
    monkeypatch.setattr(I, "STOP_PAGE", page)
    series_ = {f"S{k}": ohlcv(n, k) for k, n in enumerate([1, 2, 7, 8, 128, 129, 260])}
    df = bars(spark, series_, parts=3).withColumn("a", F.col("high") - F.col("low"))
    out = I.trailing_stop(df, "a", 1.8).cache()
    for sym, rows in series_.items():
        gap = [1.8 * (r[1] - r[2]) for r in rows]
        same(column(out, "atr_trailing", sym), stop_loop([r[3] for r in rows], gap))
    out.unpersist()


def below_loop(close, stop, tie=1e-9):
    """The bars where the close crosses below the stop; a tie keeps the side, a hole forgets it."""
    out, above = [], False
    for s, t in zip(close, stop):
        if s is None or t is None:
            above, crossed = False, False
        elif abs(s - t) <= tie * max(abs(s), abs(t)):
            crossed = False
        else:
            crossed, above = above and s < t, s > t
        out.append(crossed)
    return out


def test_trailing_stop_with_holes_and_crossings(spark, monkeypatch):
    monkeypatch.setattr(I, "STOP_PAGE", 16)
    series_ = {f"S{k}": [list(r) for r in ohlcv(120, k, ties=True)] for k in range(4)}
    for k, rows in enumerate(series_.values()):
        for i in range(5 + k, 120, 23):
            rows[i][3] = None if i % 2 else float("nan")
    df = bars(spark, series_, parts=3).withColumn("a", F.lit(0.5))
    out = I.trailing_stop(df, "a", 2.0, carry=["date", "close"], below="under").cache()
    for sym, rows in series_.items():
        close = [None if r[3] is None or r[3] != r[3] else r[3] for r in rows]
        want = stop_loop(close, [1.0] * len(rows))
        same(column(out, "atr_trailing", sym), want)
        assert column(out, "under", sym) == below_loop(close, want)
    assert out.where("under").count() > 0
    out.unpersist()


def test_trailing_stop_after_a_window_in_another_order(spark):
    series_ = {f"S{k}": ohlcv(80 + k, k) for k in range(4)}
    df = with_rn(bars(spark, series_, parts=3)).withColumn("a", F.col("high") - F.col("low"))
    other = Window.partitionBy("symbol", F.col("rn") % 7).orderBy("close")
    df = df.withColumn("top", F.max("close").over(other))
    out = I.trailing_stop(df, "a", 1.8, carry=["date", "top", "close"])
    for sym, rows in series_.items():
        gap = [1.8 * (r[1] - r[2]) for r in rows]
        same(column(out, "atr_trailing", sym), stop_loop([r[3] for r in rows], gap))


def gap_ema_loop(x, n):
    """Starts with the first value; undefined from the first later gap on."""
    out, seen, y = [], [], None
    gone = False
    for v in x:
        gone = gone or (v is None and bool(seen))
        if v is not None and not gone:
            seen.append(v)
            if len(seen) == n:
                y = sum(seen) / n
            elif len(seen) > n:
                y += (v - y) * 2 / (n + 1)
        out.append(None if gone or len(seen) < n else y)
    return out


@pytest.mark.parametrize("x", [
    [10.0] * 8 + [None] + [10.0] * 8,
    [None] * 3 + [float(i % 5 + 1) for i in range(20)],
    [None, None] + [float(i % 7 + 1) for i in range(12)] + [None] + [3.0] * 9,
    [None] * 9,
])
def test_averages_with_gaps(spark, x):
    df = closes(spark, {"A": [1.0] * len(x)}).withColumn(
        "close", F.element_at(F.array(*[F.lit(v).cast("double") for v in x]), F.datediff("date", F.lit(DAY0)) + 1)
    )
    same(column(I.ema(df, 5), "ema"), gap_ema_loop(x, 5))
    first = next((i for i, v in enumerate(x) if v is not None), len(x))
    last = next((i for i in range(first, len(x)) if x[i] is None), len(x))
    whole = closes(spark, {"A": x[first:last]}) if last > first else None
    for f, name in ((lambda d: I.rsi(d, 3), "rsi"), (I.kalman, "kf"), (lambda d: I.macd(d, 2, 3, 2), "macd")):
        inner = column(f(whole), name) if whole is not None else []
        same(column(f(df), name), [None] * first + inner + [None] * (len(x) - last))


def t_cdf_balance(z, nu):
    """2·CDF - 1 by the substitution t = sqrt(nu)·tan(a), Simpson's rule."""
    hi, n = math.atan(abs(z) / math.sqrt(nu)), 20000
    f = lambda a: math.cos(a) ** (nu - 1)
    h = hi / n
    total = f(0) + f(hi) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n))
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
    return 2 * c * total * h / 3


def test_student_t(spark):
    zs = [0.0, 0.01, 0.3, 0.5, 0.7, 1.0, 2.5, 10.0]
    df = spark.createDataFrame([(i, z * z) for i, z in enumerate(zs)], "i int, z2 double")
    got = [r.p for r in df.withColumn("p", S.student_t_balance(F.col("z2"), 0.25)).orderBy("i").collect()]
    same(got, [t_cdf_balance(z, 0.25) for z in zs], 1e-5)


def test_constant_price_has_no_balance(spark):
    got = column(I.bvc(closes(spark, {"A": [7.0] * 30})), "bvc")
    assert got[:20] == [None] * 20 and set(got[20:]) == {0.0}


def test_symbols_do_not_touch_each_other(spark):
    one, two = ohlcv(260, 1), ohlcv(240, 2)
    specs = [Spec(n) for n in ("rsi", "macd", "bbands", "vwap", "atr_trailing", "kalman_zscore")]
    both = with_indicators(bars(spark, {"A": one, "B": two}), specs)
    alone = with_indicators(bars(spark, {"B": two}), specs)
    names = sorted(set(both.columns) - {"symbol", "date"})
    got = both.where("symbol = 'B'").select("date", *names).orderBy("date").collect()
    assert got == alone.select("date", *names).orderBy("date").collect()


def test_unknown_indicator_is_an_error(spark):
    with pytest.raises(ValueError):
        with_indicators(closes(spark, {"A": [1.0]}), [Spec("nope")])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=3, max_size=25), st.integers(2, 6))
def test_sliding_extreme(spark, values, n):
    df = series.with_rn(closes(spark, {"A": values}))
    df = series.sliding_argextremes(df, "close", n, {"hi": "highest", "lo": "lowest"})
    for i, r in enumerate(df.orderBy("date").collect()):
        w = values[max(0, i - n + 1) : i + 1]
        if len(w) < n:
            assert r.hi is None and r.lo is None
        else:
            assert (r.hi, r.lo) == (i - n + 1 + w.index(max(w)), i - n + 1 + w.index(min(w)))


def test_yz_and_zscore_warmup(spark):
    data = {"A": ohlcv(50, 3)}
    vol = column(I.yz_volatility(bars(spark, data), 10), "yz_volatility")
    assert vol[:10] == [0.0] * 10 and all(v > 0 for v in vol[10:])
    z = column(I.kalman_zscore(bars(spark, data), 20), "kalman_zscore")
    assert z[:19] == [0.0] * 19 and any(z[19:])


def test_log_distance_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 2.0), (4.0, 2.0)], "a double, b double")
    got = [r.x for r in df.select(S.log_distance(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[:2] == [None, None] and math.isclose(got[2], math.log(2))




def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_carried_by_one_list(spark):
    """However many decays share a block, none has a frame of its own for each block before."""
    text = _plan(I.emas(closes(spark, {"A": walk(50)}), {f"e{n}": n for n in (12, 30, 34, 200)}))
    assert "RangeFrame" not in text and text.count("collect_list(") == 1


def test_a_state_of_the_trailing_stop_holds_no_list(spark):
    """A state is copied in depth at every bar; with the stops before it, that cost grew with the page."""
    text = _plan(I.atr_trailing(closes(spark, {"A": walk(50)})))
    assert "aggregate(" in text and ", out, concat(" not in text
