import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from helpers import DAY0, bars, closes, ohlcv
from pyspark.sql import functions as F

from barline import schemas
from barline.functions import scalars as S
from barline.operators import portfolio, reports, risk, sectors, tables
from barline.plans import optimize
from barline.session import checkpoint_dir, cut_lineage
from barline.sources import sector_import
from barline.sources import tables as scans
from barline.streaming.latest import latest_prices


def lots(spark, rows):
    data = [(i, t, Decimal(q), Decimal(p), DAY0, None) for i, t, q, p in rows]
    return spark.createDataFrame(data, schemas.POSITIONS)


def requests(spark, rows):
    data = [
        (s, p, Decimal(q), Decimal(c), DAY0, None if f is None else Decimal(f), None)
        for s, p, q, c, f in rows
    ]
    return spark.createDataFrame(data, schemas.CLOSE_REQUESTS)


def test_close_positions_in_sequence(spark):
    own = lots(spark, [(1, "AAA", "10", "100"), (2, "BBB", "5", "50"), (3, "CCC", "7", "20")])
    asked = requests(
        spark,
        [
            (1, 1, "8", "110", "2"),
            (2, 1, "3", "110", "1"),  # only 2 left
            (3, 1, "2", "120", None),  # still fits
            (4, 2, "6", "60", "0"),  # more than the lot
            (5, 9, "1", "10", "0"),  # no such lot
            (6, 3, "0", "10", "0"),  # invalid
        ],
    )
    left, sells, refused = portfolio.close_positions(own, asked)
    assert {(r.id, str(r.quantity)) for r in left.collect()} == {(2, "5.000000"), (3, "7.000000")}
    got = {r.id: r for r in sells.collect()}
    assert set(got) == {1, 3}
    assert got[1].transaction_type == "sell" and got[1].price == 100 and got[1].close_price == 110
    assert got[1].notes == "Position closure - Realized P/L: 78.000000"
    assert {(r.seq, r.status) for r in refused.collect()} == {
        (2, "over"), (4, "over"), (5, "missing"), (6, "quantity_to_close"),
    }


def test_hot_lot_against_loop(spark):
    """One lot with most of the requests, in several partitions and Arrow batches."""
    rnd = random.Random(5)
    own = lots(spark, [(1, "HOT", "500", "10"), (2, "COLD", "9", "10")])
    rows = [(i, 1 if rnd.random() < 0.9 else 2, str(rnd.randint(1, 40)), "11", "0") for i in range(1, 400)]
    got = {r.seq: r.status for r in portfolio.apply_requests(own, requests(spark, rows).repartition(5)).collect()}
    left = {1: 500, 2: 9}
    for seq, lot, q, _, _ in rows:
        ok = int(q) <= left[lot]
        assert (got[seq] == "accepted") == ok
        left[lot] -= int(q) if ok else 0


def test_summary_without_lots_is_zero(spark):
    priced = lots(spark, []).withColumn("current_price", F.lit(1.0))
    assert portfolio.portfolio_summary(priced).collect()[0].total_profit_loss_pct == 0.0


def test_price_falls_back_to_purchase_price(spark):
    prices = closes(spark, {"AAA": [1, 2, 3, 4, 5, 6, 7, 8]})
    own = lots(spark, [(1, "AAA", "1", "100"), (2, "ZZZ", "1", "50")])

    def at(day):
        priced = portfolio.price_positions(own, prices, DAY0 + dt.timedelta(days=day))
        return {r.id: r.current_price for r in priced.collect()}

    assert at(7) == {1: 8.0, 2: 50.0}
    assert at(10) == {1: 8.0, 2: 50.0}  # three days old still counts
    assert at(11) == {1: 100.0, 2: 50.0}
    assert at(2) == {1: 3.0, 2: 50.0}


def test_rounding_per_lot_before_summing(spark):
    own = lots(spark, [(1, "A", "0.5", "1"), (2, "A", "0.5", "1")]).withColumn("current_price", F.lit(2.0))
    row = portfolio.by_ticker(own).collect()[0]
    assert (row.total_quantity, row.total_cost_basis, row.total_current_value) == (2.0, 2.0, 2.0)


def test_js_round_goes_up_on_ties(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (-2.6,)], "x double")
    assert [r.y for r in df.select(S.js_round(F.col("x")).alias("y")).collect()] == [-2.0, 3.0, -3.0]


def test_realized_profit_treats_zero_close_as_missing(spark):
    df = spark.createDataFrame(
        [(Decimal(10), Decimal(0), Decimal(2), Decimal(1)), (Decimal(10), Decimal(12), Decimal(2), None)],
        "price decimal(15,6), close_price decimal(15,6), quantity decimal(15,6), fees decimal(10,2)",
    )
    assert [r.realized_pl for r in portfolio.realized_pl(df).collect()] == [-1.0, 4.0]


def test_validation_reasons(spark):
    rows = [("", "hold", -1.0, 0.0, -1.0, None), ("ABC", "buy", 1.0, 1.0, None, DAY0)]
    schema = "ticker string, transaction_type string, quantity double, price double, fees double, transaction_date date"
    checked = tables.validate(spark.createDataFrame(rows, schema), tables.transaction_checks())
    assert tables.valid_rows(checked).count() == 1
    assert len(tables.rejected_rows(checked).collect()[0].reasons) == 6


def test_replace_writes_nulls_and_ignores_unknown_ids(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "z", 1), (2, "x", 4), (2, "y", 1)], "id int, s string, seq int")
    assert {tuple(r) for r in tables.replace_by_key(old, new, "seq").collect()} == {(1, "a", 1), (2, None, 2)}


def test_upsert_keeps_fields_not_given(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "y", 1), (3, "z", 2), (2, "q", 3)], "id int, s string, seq int")
    got = {tuple(r) for r in tables.upsert(old, new, ["id"], "seq").collect()}
    assert got == {(1, "a", 1), (2, None, 2), (3, "z", None)}


def test_set_latest_amount(spark):
    schema = "id long, amount decimal(15,2), date date, notes string"
    old = spark.createDataFrame(
        [(1, Decimal(5), DAY0, None), (2, Decimal(6), DAY0 + dt.timedelta(days=1), None)], schema
    )
    row = spark.createDataFrame([(Decimal(9), DAY0, "x")], "amount decimal(15,2), date date, notes string")
    got = {r.id: (r.amount, r.notes) for r in tables.set_latest_amount(old, row).collect()}
    assert got == {1: (Decimal("5.00"), None), 2: (Decimal("9.00"), "x")}
    empty = tables.set_latest_amount(spark.createDataFrame([], schema), row).collect()
    assert [(r.amount, r.notes) for r in empty] == [(Decimal("9.00"), "x")]


def test_sector_import_rules(spark, tmp_path):
    payload = [
        {"id": 1, "type": 3, "data": [{"key": "pe_d", "value": "1.5"}, {"key": "pe_d", "value": 2.5},
                                       {"key": "bogus", "value": 9}, {"key": "name", "value": "Ngân hàng"}]},
        17,
        {"id": None, "type": "x", "data": []},
        {"type": "x", "data": [{"key": "id", "value": 5}, {"key": "level", "value": 2}, 4]},
        {"id": 7, "data": None},
    ]
    (tmp_path / "s.json").write_text(json.dumps(payload), encoding="utf-8")
    got = {r.id: r for r in sector_import.read_sector_json(spark, str(tmp_path), 4).collect()}
    assert set(got) == {1, 5, 7}
    assert got[1].pe_d == Decimal("2.5") and got[1].type == "3" and got[1].name == "Ngân hàng"
    assert got[5].level == 2 and got[7].level == 4 and got[7].type is None


def test_search_without_diacritics(spark):
    df = spark.createDataFrame([("Bất động sản", "x"), ("Điện", "y"), ("Oil", "z")], "name string, type string")

    def hits(term):
        return {r.name for r in sectors.search(df, term, ["name", "type"]).collect()}

    assert hits("bat dong") == {"Bất động sản"}
    assert hits("BẤT") == {"Bất động sản"}
    assert hits("dien") == {"Điện"} == hits("đi")
    assert hits("Z") == {"Oil"}


@pytest.mark.parametrize(
    "period,day,mode,want",
    [
        ("1M", dt.date(2024, 3, 31), "calendar", dt.date(2024, 3, 2)),  # 31 February runs over
        ("1Y", dt.date(2024, 2, 29), "calendar", dt.date(2023, 3, 1)),
        ("YTD", dt.date(2024, 5, 5), "calendar", dt.date(2024, 1, 1)),
        ("3M", dt.date(2024, 5, 5), "days", dt.date(2024, 2, 5)),
        ("CUSTOM", dt.date(2024, 5, 5), "calendar", dt.date(2023, 5, 6)),
    ],
)
def test_period_start(spark, period, day, mode, want):
    got = spark.range(1).select(sectors.period_start(period, day, mode=mode).alias("d")).collect()[0].d
    assert got == want


def test_period_outside_the_data_returns_everything(spark):
    df = closes(spark, {"A": range(1, 11)})
    day = DAY0 + dt.timedelta(days=9)
    assert sectors.period_filter(df, "CUSTOM", day, custom=DAY0 + dt.timedelta(days=5)).count() == 5
    assert sectors.period_filter(df, "CUSTOM", day, custom=DAY0 + dt.timedelta(days=50)).count() == 10
    assert sectors.period_filter(df, "10Y", day).count() == 10
    assert sectors.period_filter(df, "ALL", day).count() == 10


def test_performance_skips_zero_start(spark):
    df = closes(spark, {"A": [0, 5], "B": [2, 3], "C": [4, 2]})
    perf = sectors.period_performance(df, ["symbol"])
    assert [r.symbol for r in sectors.top_n(perf, 50, "symbol", clamp=(1, 2)).collect()] == ["B", "C"]
    assert [r.symbol for r in sectors.ranked(perf, "symbol").collect()] == ["B", "A", "C"]


def test_reports(spark):
    t = dt.datetime(2020, 1, 5, 12)
    rows = [
        (1, "A", "old", "u1", "s", dt.datetime(2020, 1, 1), None),
        (1, "A", "new", "u2", "s", t, None),
        (2, "A", "undated", "u3", "s", None, None),
        (3, "B", "midnight", "u4", "s", dt.datetime(2020, 1, 5), None),
    ]
    df = spark.createDataFrame(rows, schemas.REPORTS)
    latest = reports.latest_reports(df)
    assert {(r.id, r.url) for r in latest.collect()} == {(1, "u2"), (2, "u3"), (3, "u4")}
    assert [r.id for r in reports.newest_first(latest).collect()] == [1, 3, 2]
    assert scans.reports_for(df, "a").count() == 3
    near = reports.nearby(closes(spark, {"A": [1] * 12, "B": [1] * 12}), latest)
    days = {s: sorted(r.date.day for r in near.collect() if r.symbol == s) for s in "AB"}
    assert days == {"A": [2, 3, 4, 5, 6, 7, 8, 9], "B": [2, 3, 4, 5, 6, 7, 8]}


def test_percent_rank_with_ties_and_a_hot_value(spark):
    rnd = random.Random(2)
    rows = [("g", i, 7.0 if i % 3 == 0 else round(rnd.uniform(0, 20), 1)) for i in range(300)]
    rows += [("h", 1, 5.0), ("k", 1, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    df = df.withColumn("s", risk.slice_of(F.col("v") - 8.0, F.lit(4.0), 5))
    assert df.select("s").distinct().count() > 3
    got = {(r.g, r.i): r.p for r in risk.percent_rank_by(df, ["g"], "v", "p", "s").collect()}
    vals = [v for g, _, v in rows if g == "g"]
    for g, i, v in rows[:300]:
        assert abs(got[g, i] - sum(x < v for x in vals) / 299) < 1e-12
    assert got["h", 1] == 0.0 and got["k", 1] is None


def test_weights_sum_to_one_and_clean(spark):
    data = bars(spark, {f"S{k}": ohlcv(60, k) for k in range(6)})
    returns = optimize.dense_returns(data)
    made = [optimize.search(data, None, method, count=8) for method in ("ef", "cvar")]
    made += [optimize.optimize(data, None, method, DAY0) for method in ("ef", "cvar", "hrp")]
    for weights, figures in made:
        total = weights.agg(F.sum("weight")).collect()[0][0]
        assert abs(total - 1.0) < 1e-3 and figures.count() == 1
    with pytest.raises(ValueError):
        optimize.optimize(data, None, "nope")
    with pytest.raises(ValueError):
        optimize.search(data, None, "nope", count=2)


def test_hrp_keeps_tiny_weights_and_reports_the_arithmetic_mean(spark):
    data = bars(spark, {f"S{k}": ohlcv(60, k) for k in range(4)})
    returns = optimize.dense_returns(data)
    weights, figures = optimize.optimize(data, None, "hrp", DAY0)
    w = {r.symbol: r.weight for r in weights.collect()}
    mean = {r.symbol: r.m for r in returns.groupBy("symbol").agg(F.avg("ret").alias("m")).collect()}
    assert abs(figures.collect()[0].expected_return - 252 * sum(w[s] * mean[s] for s in w)) < 1e-9
    rows = [(f"K{i}", DAY0 + dt.timedelta(days=d), 0.01 * (-1) ** (d + i)) for i in range(20_000) for d in range(3)]
    many = spark.createDataFrame(rows, "symbol string, date date, ret double")
    equal = risk.inverse_variance(many)
    assert equal.count() == 20_000 and abs(equal.agg(F.sum("weight")).collect()[0][0] - 1) < 1e-9


def test_pair_matrix_of_many_keys(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    keys, days = [f"K{i:03d}" for i in range(400)], 12
    x = rng.normal(size=(days, len(keys)))
    hole = rng.random(x.shape) < 0.05
    rows = [
        (k, DAY0 + dt.timedelta(days=d), float(x[d, i]))
        for i, k in enumerate(keys) for d in range(days) if not hole[d, i]
    ]
    returns = spark.createDataFrame(rows, "symbol string, date date, ret double")
    got = {(r.a, r.b): r.covariance for r in risk.covariance(returns, keys).collect()}
    assert len(got) == 400 * 401 // 2
    corr = {(r.a, r.b): (r.correlation, r.distance) for r in risk.correlation(returns, keys).collect()}
    for i, j in [(0, 0), (3, 77), (12, 399), (200, 201), (398, 399)]:
        both = ~hole[:, i] & ~hole[:, j]
        want = np.cov(x[both, i], x[both, j])[0, 1] * 252
        assert abs(got[keys[i], keys[j]] - want) < 1e-9
        rho, gap = corr[keys[i], keys[j]]
        assert abs(rho - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
        assert abs(gap - max(0.0, (1 - rho) / 2) ** 0.5) < 1e-6


def test_portfolio_variance_equals_quadratic_form(spark):
    returns = optimize.dense_returns(bars(spark, {f"S{k}": ohlcv(50, k) for k in range(4)}))
    w = {"S0": 0.1, "S1": 0.2, "S2": 0.3, "S3": 0.4}
    weights = spark.createDataFrame(list(w.items()), "symbol string, weight double")
    vol = risk.portfolio_stats(returns, weights).collect()[0].volatility
    cov = {(r.a, r.b): r.covariance for r in risk.covariance(returns, list(w)).collect()}
    var = sum(w[a] * w[b] * c * (1 if a == b else 2) for (a, b), c in cov.items())
    assert abs(vol**2 - var) < 1e-9


def test_bars_need_a_date_and_unknown_symbols_are_empty(spark, tmp_path):
    df = closes(spark, {"A": [1, 2, 3], "B": [4, 5, 6]})
    scans.write_bars(df, str(tmp_path / "bars"))
    read = scans.load_bars(spark, str(tmp_path / "bars"), symbols=["A"], start=DAY0 + dt.timedelta(days=1))
    assert read.count() == 2
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(date" in plan and "EqualTo(symbol" in plan
    assert scans.load_bars(spark, str(tmp_path / "bars"), symbols=["ZZZ"]).count() == 0
    (tmp_path / "watch.csv").write_text("B\n\n  \n")
    watch = scans.read_watchlist(spark, str(tmp_path / "watch.csv"))
    assert {r.symbol for r in scans.load_bars(spark, str(tmp_path / "bars"), watchlist=watch).collect()} == {"B"}
    with pytest.raises(TypeError):
        scans.check_bars(df.withColumn("date", F.col("date").cast("timestamp")))


def test_checkpoint_folder(spark, tmp_path):
    assert cut_lineage(closes(spark, {"A": [1, 2]})).count() == 2
    assert checkpoint_dir(spark)


def test_stream_keeps_the_latest_price(spark, tmp_path):
    src = str(tmp_path / "in")
    closes(spark, {"A": [1, 2, 3], "B": [4, 5]}).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schemas.BARS).parquet(src)
    q = latest_prices(stream).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert {r.symbol: r.price for r in spark.table("latest").collect()} == {"A": 3.0, "B": 5.0}


def test_sums_of_money_do_not_depend_on_the_order(spark):
    amounts = [0.1, 1e15, -1e15, 0.2, 3e-8, None] * 40
    want = None
    for seed in range(4):
        rows = [(x,) for x in random.Random(seed).sample(amounts, len(amounts))]
        got = spark.createDataFrame(rows, "x double").repartition(3).agg(S.exact_sum(F.col("x"))).first()[0]
        assert want in (None, got) and abs(got - 12.0000012) < 1e-12
        want = got
    for odd in (float("inf"), 1e25):
        df = spark.createDataFrame([(odd,), (1.0,), (None,)], "x double")
        assert df.agg(S.exact_sum(F.col("x"))).first()[0] == odd
    assert spark.createDataFrame([], "x double").agg(S.exact_sum(F.col("x"))).first()[0] is None


def test_partitions_by_symbol_grow_with_the_ticks(spark):
    import re

    from barline.operators import indicators
    from barline.sources import derived

    sf = "/root/testdata/sf0.01"
    ticks = derived.table(spark, sf, "lineitem").count()
    bars = derived.bars_by_symbol(spark, sf, 1000)
    assert bars.rdd.getNumPartitions() == -(-ticks // 1000)
    assert sorted(bars.collect()) == sorted(derived.bars(spark, sf).collect())
    # Windows by symbol follow that exchange, whatever the session's number of partitions.
    text = indicators.macd(bars)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(symbol#\d+, (\d+)\)", text) == [str(-(-ticks // 1000))]


def test_windowed_queries_take_bars_by_symbol(spark):
    import re

    from barline.catalog import QUERIES

    for name in ("indicator_board", "macd", "vwap_highest", "squeeze_signals", "ttm_signals", "squeeze_backtest", "ttm_backtest"):
        text = QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in text, name
        assert not re.search(r"hashpartitioning\(symbol#\d+, \d+\), ENSURE_REQUIREMENTS", text), name
