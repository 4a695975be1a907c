import datetime as dt
import random

import pytest
from helpers import DAY0, bars, closes, column, ohlcv, same
from pyspark.sql import functions as F

from barline.functions.series import with_rn
from barline.operators import grid, signals, trades
from barline.plans import backtest


def flags(spark, rows):
    """{symbol: [(close, entry, leave)]}"""
    data = [
        (s, DAY0 + dt.timedelta(days=i), None if c is None else float(c), e, x)
        for s, v in rows.items()
        for i, (c, e, x) in enumerate(v)
    ]
    schema = "symbol string, date date, close double, entry_0 boolean, exit_0 boolean"
    return with_rn(spark.createDataFrame(data, schema))


def random_flags(n, seed):
    rnd = random.Random(seed)
    return [(rnd.randint(5, 30), rnd.random() < 0.3, rnd.random() < 0.25) for _ in range(n)]


def test_crossings(spark):
    x = [1, 2, 3, 3, 4, None, 5, 2, 3, 2]
    y = [2, 2, 2, 3, 3, 3, 3, 3, 3, 3]
    rows = [(f"{i:02d}", None if a is None else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "d string, x double, y double").withColumn("symbol", F.lit("A"))
    df = with_rn(df, order="d")
    pair = (F.col("x"), F.col("y"))
    out = signals.crossings(df, {"up": (*pair, "above"), "dn": (*pair, "below")}).orderBy("d").collect()
    # below, tie, above = a cross; a tie inside a run is none; after the gap 5 > 3 starts over
    assert [i for i, r in enumerate(out) if r.up] == [2]
    assert [i for i, r in enumerate(out) if r.dn] == [7]


def test_ties_do_not_cross(spark):
    df = closes(spark, {"A": [1, 2, 2, 1, 2, 3]})
    out = signals.crossings(with_rn(df), {"up": (F.col("close"), F.lit(2.0), "above")})
    assert column(out, "up") == [False, False, False, False, False, True]


def test_first_entries_against_state_machine(spark):
    data = {f"S{k}": random_flags(60, k) for k in range(8)}
    out = signals.first_entries(flags(spark, data), "entry_0", "exit_0")
    for sym, rows in data.items():
        held, want = False, []
        for _, e, x in rows:
            hit = e and not held
            want.append(hit)
            held = hit or (held and not x)
        assert column(out, "first_entry", sym) == want


def test_low_at_entry_breaks_on_missing_low(spark):
    low = [5.0, 4.0, 3.0, None, 2.0, 1.0]
    entry = [True, True, False, False, False, True]
    rows = [("A", DAY0 + dt.timedelta(days=i), l, e) for i, (l, e) in enumerate(zip(low, entry))]
    df = spark.createDataFrame(rows, "symbol string, date date, low double, e boolean")
    assert column(signals.low_at_entry(df, "e"), "low_at_entry") == [None, 4, 4, None, None, 1]


def trades_loop(rows):
    held, out, cash = None, [], 100.0
    for i, (c, e, x) in enumerate(rows):
        if e == x:
            continue
        if e and held is None:
            held = (i, c)
        elif x and held is not None:
            out.append((held[0], i, float(held[1]), float(c), cash * (c / held[1] - 1)))
            cash *= c / held[1]
            held = None
    if held is not None:
        last = rows[-1][0]
        out.append((held[0], None, float(held[1]), float(last), cash * (last / held[1] - 1)))
    return out


def test_trades_against_state_machine(spark):
    data = {f"S{k}": random_flags(70, 100 + k) for k in range(10)}
    out = trades.to_trades(trades.stack_params(flags(spark, data), 1))
    for sym, rows in data.items():
        got = out.where(F.col("symbol") == sym).orderBy("entry_idx").collect()
        want = trades_loop(rows)
        assert [(g.entry_idx, g.exit_idx, g.entry_price, g.exit_price) for g in got] == [w[:4] for w in want]
        same([g.pnl for g in got], [w[4] for w in want], 1e-8)
        for a, b in zip(got, got[1:]):
            assert a.exit_idx is not None and a.exit_idx < b.entry_idx


def test_exit_before_entry_and_same_bar(spark):
    rows = [(10, False, True), (10, True, True), (11, True, False), (12, True, False), (15, False, True)]
    got = trades.to_trades(trades.stack_params(flags(spark, {"A": rows}), 1)).collect()
    assert [(g.entry_idx, g.exit_idx) for g in got] == [(2, 4)]


def test_open_trade_replaces_closed_one(spark):
    schema = "symbol string, entry_idx int, param_id int, type string"
    rows = [
        ("A", 1, 0, "closed_trades"),
        ("A", 1, 1, "open_trades"),
        ("A", 2, 0, "closed_trades"),
        ("A", 2, 1, "closed_trades"),
    ]
    got = trades.merge_param_sets(spark.createDataFrame(rows, schema)).orderBy("entry_idx").collect()
    assert [(g.entry_idx, g.param_id, g.type) for g in got] == [
        (1, 1, "open_trades"),
        (2, 0, "closed_trades"),
    ]


def test_densify_fills_back_then_forward(spark):
    d = [DAY0 + dt.timedelta(days=i) for i in range(5)]
    rows = [("A", d[0], 1.0), ("A", d[3], None), ("A", d[4], 5.0), ("B", d[1], 7.0), ("B", d[2], None)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    out = grid.densify(df, fields=["close"])
    # day 3 of A is missing its close and takes the next one, as do the days before it
    assert column(out, "close", "A") == [1.0, 5.0, 5.0, 5.0, 5.0]
    # B starts late and ends early
    assert column(out, "close", "B") == [7.0, 7.0, 7.0, 7.0, 7.0]


def test_densify_against_loop(spark):
    rnd = random.Random(3)
    days = [DAY0 + dt.timedelta(days=i) for i in range(30)]
    cells = {
        (s, d): (None if rnd.random() < 0.2 else rnd.random())
        for s in "ABCDE"
        for d in days
        if rnd.random() < 0.4
    }
    df = spark.createDataFrame(
        [(s, d, v) for (s, d), v in cells.items()], "symbol string, date date, close double"
    )
    out = grid.densify(df, fields=["close"])
    seen = sorted({d for _, d in cells})
    for s in "ABCDE":
        vals = [cells.get((s, d)) for d in seen]
        back = [next((v for v in vals[i:] if v is not None), None) for i in range(len(vals))]
        want = [
            v if v is not None else next((w for w in reversed(back[:i]) if w is not None), None)
            for i, v in enumerate(back)
        ]
        assert column(out, "close", s) == want


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        signals.strategy_params("Buy High")


@pytest.mark.parametrize("name", [signals.SQUEEZE, signals.TTM])
def test_one_set_alone_gives_the_same_trades(spark, name):
    """The side-by-side sweep must not mix parameter sets."""
    df = bars(spark, {f"S{k}": ohlcv(320, k) for k in range(3)})
    sweep = signals.strategy_params(name)
    together = backtest.strategy_trades(df, name, sweep).cache()
    for i, p in enumerate(sweep):
        alone = backtest.strategy_trades(df, name, [p]).drop("param_id")
        mine = together.where(F.col("param_id") == i).select(alone.columns)
        assert mine.exceptAll(alone).count() == 0 and alone.exceptAll(mine).count() == 0
    assert together.count() > 0
    together.unpersist()


def test_metadata_round_trip(spark):
    df = spark.createDataFrame([("A", 0, 0)], "symbol string, entry_idx int, param_id int")
    row = trades.with_metadata(df, [{"b": 1.5, "a": "x"}]).collect()[0]
    assert row.metadata == {"a": "x", "b": "1.5"} and row.metadata_text == "a: x, b: 1.5"
