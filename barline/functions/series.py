"""Window building blocks for ordered per-key series.

Size bound. A series is keyed by ``(symbol, date)`` with a DATE column and unique keys
(``sources.tables.check_bars`` verifies the type, ``sources.derived.bars`` builds it by
grouping). One key therefore holds at most one row per calendar day: 36,525 rows per century,
a few MB. A key cannot hold a third of a large table, so windows partitioned by key are safe;
raw ticks, where a key can be that hot, are aggregated map-side before this point.

Cost rules followed here:
* one exchange per pipeline: every window partitions by the same key, or by (key, x), which
  hash partitioning by key already satisfies;
* only running frames and short sliding frames. A frame ending at UNBOUNDED FOLLOWING is
  quadratic in Spark, so look-ahead fills order descending instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "symbol"
ORDER = "date"
RN = "rn"


def along(by: str = KEY, order: str = RN) -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def running(by: str = KEY, order: str = RN) -> WindowSpec:
    return along(by, order).rowsBetween(Window.unboundedPreceding, 0)


def trailing(n: int, by: str = KEY, order: str = RN) -> WindowSpec:
    """The last n rows including the current one."""
    return along(by, order).rowsBetween(-(n - 1), 0)


def backward(by: str = KEY, order: str = RN) -> WindowSpec:
    """Running frame in descending order: 'this row and everything after it'."""
    return (
        Window.partitionBy(by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    )


def with_rn(df: DataFrame, by: str = KEY, order: str = ORDER) -> DataFrame:
    """0-based bar index per key; kept if the table already has one."""
    if RN in df.columns:
        return df
    return df.withColumn(RN, F.row_number().over(along(by, order)) - 1)


def full_window(n: int, value: Column) -> Column:
    """NULL until n bars exist."""
    return F.when(F.col(RN) >= n - 1, value)


def fill_forward(c: Column | str, by: str = KEY, order: str = RN) -> Column:
    return F.last(c, ignorenulls=True).over(running(by, order))


def fill_backward(c: Column | str, by: str = KEY, order: str = RN) -> Column:
    return F.last(c, ignorenulls=True).over(backward(by, order))


# Frames up to this length are read as offsets. A sliding aggregate re-adds its whole frame for
# every row; ``lag`` only moves a pointer, and the arithmetic over the offsets is compiled. Longer
# frames would make the compiled expression too large to pay off. A short frame's sum is a column of its
# own: written out at each use, it made methods of over 8,000 bytes of code, which the JVM only interprets.
SHORT = 12
#: Kinds that need to know whether a frame is flat.
AVERAGED = ("mean", "std_pop", "std_samp")


def rolling(df: DataFrame, specs: dict[str, tuple[str, str, int]], by: str = KEY) -> DataFrame:
    """Add ``out: (kind, value, n)`` over the last n bars; kind is mean, max, min, std_pop,
    std_samp or sum. NULL until n values exist and wherever one of them is missing.

    Means of equal values are exactly that value, and deviations of equal values exactly 0: a sum
    divided by n can miss by one bit, and a filled grid is full of flat stretches that get
    compared.
    """
    df = with_rn(df)
    short = {o: s for o, s in specs.items() if s[2] <= SHORT}
    reach: dict[str, int] = {}
    for _, value, n in short.values():
        reach[value] = max(reach.get(value, 1), n)
    offsets = {
        f"_o_{value}_{k}": F.lag(value, k).over(along(by))
        for value, n in reach.items()
        for k in range(1, n)
    }
    # index of the last missing value, for the longer frames, and of the last change of value
    marks = {}
    for value in sorted({v for _, v, n in specs.values() if n > SHORT}):
        gap = F.when(F.col(value).isNull(), F.col(RN))
        marks[f"_n_{value}"] = F.last(gap, ignorenulls=True).over(running(by))
    for value in sorted({v for kind, v, n in specs.values() if n > SHORT or kind in AVERAGED}):
        new = F.when((F.col(RN) == 0) | ~F.col(value).eqNullSafe(F.col(f"_v_{value}")), F.col(RN))
        offsets[f"_v_{value}"] = F.lag(value).over(along(by))
        marks[f"_g_{value}"] = F.last(new, ignorenulls=True).over(running(by))
    sums: dict[str, Column] = {}
    means: dict[str, Column] = {}
    plain: dict[str, Column] = {}
    spread: dict[str, Column] = {}
    for out, (kind, value, n) in specs.items():
        if out in short:
            cells = [F.col(value), *(F.col(f"_o_{value}_{k}") for k in range(1, n))]
            whole = cells[-1]
            for c in reversed(cells[:-1]):
                whole = whole + c
            sums[f"_w_{value}_{n}"] = whole
            whole = F.col(f"_w_{value}_{n}")
            high = F.greatest(*cells) if n > 1 else cells[0]
            low = F.least(*cells) if n > 1 else cells[0]
            known = whole.isNotNull()
        else:
            w = trailing(n, by)
            known = (F.col(RN) >= n - 1) & (F.col(RN) - F.coalesce(f"_n_{value}", F.lit(-1)) >= n)
            whole, high, low = F.sum(value).over(w), F.max(value).over(w), F.min(value).over(w)
        flat, level = F.col(RN) - F.col(f"_g_{value}") >= n - 1, F.col(value)
        if kind == "sum":
            plain[out] = F.when(known, whole)
        elif kind in ("max", "min"):
            plain[out] = F.when(known, high if kind == "max" else low)
        else:
            mean = F.when(known, F.when(flat, level).otherwise(whole / F.lit(float(n))))
            if kind == "mean":
                plain[out] = mean
            elif out in short:
                m = f"_m_{value}_{n}"
                means[m] = mean
                squares = [(c - F.col(m)) * (c - F.col(m)) for c in cells]
                total = squares[0]
                for q in squares[1:]:
                    total = total + q
                spread[out] = F.sqrt(total / F.lit(float(n if kind == "std_pop" else n - 1)))
            else:
                dev = F.stddev_pop if kind == "std_pop" else F.stddev_samp
                plain[out] = F.when(known, F.when(flat, F.lit(0.0)).otherwise(dev(value).over(w)))
    if offsets:
        df = df.withColumns(offsets)
    if marks:
        df = df.withColumns(marks)
    if sums:
        df = df.withColumns(sums)
    df = df.withColumns({**means, **plain}) if means or plain else df
    df = df.withColumns(spread) if spread else df
    return df.drop(*offsets, *marks, *sums, *means)


def _block_rows(r: float) -> int:
    """Longest block whose total decay r^B stays at 1e-500. Weights run from the middle of the
    block, so they lie between 1e-250 and 1e250, far from overflow either way."""
    return max(1, math.floor(500.0 / -math.log10(r))) if r > 0.0 else 1 << 40


def _lags(r: float, size: int) -> int:
    """Earlier blocks that matter: r^((k-1)·size) of the next one is below the smallest double."""
    return math.ceil(324.0 / (-math.log10(r) * size)) if r > 0.0 else 0


#: Blocks of this many rows are few whatever the calendar; of shorter ones a slower decay may need this many.
LONG, MOST_LAGS = 1024, 6


def decayed_sums(df: DataFrame, terms: dict[str, tuple[str, float]], by: str = KEY) -> DataFrame:
    """Add y[t] = r·y[t-1] + b[t] for each ``name: (b_column, r)``, 0 <= r < 1; null b is 0.

    This is the one recurrence behind exponential and Wilder averages, the Kalman filter after
    its gain settles and the decayed volume balance. It runs as windows, not as a Python loop:
    inside a block of B rows, y = r^p · Σ b·r^-p with p counted from the block's middle. The carried
    state is a fold over the last sums of the blocks before, which one running list holds: a block is
    thousands of rows long unless a decay is very fast, and then the list's older part no longer counts.

    Terms share a block length, and with it one sort, unless the list would then grow long.
    """
    for _, r in terms.values():
        if not 0.0 <= r < 1.0:
            raise ValueError(f"decay must be in [0, 1), got {r}")
    groups: list[list[str]] = []
    for name in sorted(terms, key=lambda n: terms[n][1]):
        r = terms[name][1]
        size = _block_rows(terms[groups[-1][0]][1]) if groups else 0
        if groups and (size >= LONG or _lags(r, size) <= MOST_LAGS):
            groups[-1].append(name)
        else:
            groups.append([name])
    for group in groups:
        df = _decayed_group(df, {n: terms[n] for n in group}, by)
    return df


def _decayed_group(df: DataFrame, terms: dict[str, tuple[str, float]], by: str) -> DataFrame:
    keep = [c for c in df.columns if c not in terms]
    size = min(_block_rows(r) for _, r in terms.values())
    pos, mid = F.col("_pos"), F.lit(float(size // 2))
    inside = Window.partitionBy(by, "_blk").orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    # (block, rn) is the same order as rn and is the one the rows are in by then
    before = Window.partitionBy(by).orderBy("_blk", RN).rowsBetween(Window.unboundedPreceding, -1)
    local, ends, final = {}, [], []
    # one power per distinct decay; it costs more than the window it feeds
    decays = sorted({r for _, r in terms.values() if r > 0.0})
    powers = {f"_p{i}": F.pow(F.lit(r), pos - mid) for i, r in enumerate(decays)}
    for name, (b, r) in terms.items():
        value, here = F.coalesce(F.col(b), F.lit(0.0)), f"_s_{name}"
        if r == 0.0:
            local[here] = value
            final.append(F.col(here).alias(name))
            continue
        power = F.col(f"_p{decays.index(r)}")
        local[here] = F.sum(value / power).over(inside) * power
        ends.append(F.col(here).alias(name))
        onward = power * F.lit(r ** (size // 2 + 1))
        carried = F.aggregate("_ends", F.lit(0.0), _carry(name, r**size))
        final.append(F.when(F.size("_ends") > 0, F.col(here) + onward * carried).otherwise(F.col(here)).alias(name))
    out = df.withColumns(
        {
            "_blk": F.floor(F.col(RN) / F.lit(size)),
            "_pos": (F.col(RN) % F.lit(size)).cast("double"),
        }
    )
    out = out.withColumns(powers).withColumns(local)
    if ends:
        # a block's last row: null on all others, which the list leaves out
        last = F.when(pos == size - 1, F.struct(*ends))
        out = out.withColumn("_ends", F.collect_list(last).over(before))
    return out.select(*keep, *final)


def _carry(name: str, decay: float):
    return lambda total, end: total * F.lit(decay) + end[name]


def sliding_argextremes(
    df: DataFrame, value: str, n: int, outs: dict[str, str], by: str = KEY
) -> DataFrame:
    """``out: side`` adds the index of the first maximum ('highest') or minimum ('lowest') of the
    last n bars.

    Spark re-scans a sliding frame for every row. Instead, cut the series into blocks of n:
    any window of n rows is a block's suffix plus the next block's prefix, and both are running
    frames, so the cost no longer depends on n.
    """
    keep = [c for c in df.columns if c not in outs]
    rn = F.col(RN)
    fwd = Window.partitionBy(by, "_blk").orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    bwd = (
        Window.partitionBy(by, "_blk")
        .orderBy(rn.desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # (block, rn) is the same order as rn and is the one the rows are already in
    back = Window.partitionBy(by).orderBy("_blk", RN)
    pick = {s: F.max if s == "highest" else F.min for s in outs.values()}
    choose = {s: F.greatest if s == "highest" else F.least for s in outs.values()}
    # struct order decides ties: the earliest bar wins on both sides
    points = {
        f"_pt_{s}": F.struct(F.col(value).alias("v"), (-rn if s == "highest" else rn).alias("i")) for s in pick
    }
    found = (
        df.withColumn("_blk", F.floor(rn / F.lit(n)))
        .withColumns(points)
        .withColumns({f"_suf_{s}": f(f"_pt_{s}").over(bwd) for s, f in pick.items()})
        .withColumns({f"_pre_{s}": f(f"_pt_{s}").over(fwd) for s, f in pick.items()})
        .withColumns({f"_old_{s}": F.lag(f"_suf_{s}", n - 1).over(back) for s in pick})
    )
    cols = []
    for out, s in outs.items():
        index = choose[s](f"_pre_{s}", f"_old_{s}")["i"]
        cols.append(full_window(n, -index if s == "highest" else index).alias(out))
    return found.select(*keep, *cols)
