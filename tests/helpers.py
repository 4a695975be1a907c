"""Small tables and straightforward loops to compare with."""

import datetime as dt
import math
import random

DAY0 = dt.date(2020, 1, 1)


def bars(spark, series, parts=None):
    """``{symbol: [(open, high, low, close, volume)]}`` on consecutive days."""
    rows = [
        (sym, DAY0 + dt.timedelta(days=i), *[None if x is None else float(x) for x in bar])
        for sym, values in series.items()
        for i, bar in enumerate(values)
    ]
    schema = "symbol string, date date, open double, high double, low double, close double, volume double"
    df = spark.createDataFrame(rows, schema)
    return df.repartition(parts) if parts else df


def closes(spark, series):
    return bars(spark, {s: [(c, c, c, c, 10) for c in v] for s, v in series.items()})


def walk(n, seed=1, step=1.0):
    rnd = random.Random(seed)
    out, x = [], 100.0
    for _ in range(n):
        x = max(1.0, x + rnd.uniform(-step, step))
        out.append(x)
    return out


def ohlcv(n, seed=1, ties=False):
    rnd = random.Random(seed)
    out = []
    for c in walk(n, seed, 3.0):
        c = float(round(c)) if ties else c
        hi, lo = c + rnd.uniform(0, 2), c - rnd.uniform(0, 0.9)
        out.append((rnd.uniform(lo, hi), hi, lo, c, rnd.randint(1, 50)))
    return out


def column(df, name, symbol=None):
    if symbol:
        df = df.where(f"symbol = '{symbol}'")
    return [row[name] for row in df.orderBy("symbol", "date").collect()]


def same(got, want, tol=1e-9):
    assert len(got) == len(want)
    for i, (g, w) in enumerate(zip(got, want)):
        if g is None or w is None:
            assert g is None and w is None, (i, g, w)
        else:
            assert math.isclose(g, w, rel_tol=tol, abs_tol=tol), (i, g, w)
