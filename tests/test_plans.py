"""Plan shape: shuffles, joins and where Python is allowed."""

import re

from pyspark.sql import functions as F

from barline.operators import grid, indicators, signals, trades
from barline.plans import backtest
from barline.sources import derived

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(text, node):
    return len(re.findall(rf"\b{node}\b", text))


def method_sizes(spark, df):
    """Bytes of the largest method of each compiled stage; the JVM only interprets those of over 8,000."""
    debug = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$")
    text = debug.codegenString(df._jdf.queryExecution().executedPlan())
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def largest_method(spark, make):
    """Over the plan as it is before any stage has run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return max(method_sizes(spark, make()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_bars_aggregate_before_the_shuffle(spark):
    text = plan(derived.bars(spark, SF))
    assert "partial_min_by" in text and "SortAggregate" not in text
    assert count(text, "Exchange hashpartitioning") == 1


def test_scan_reads_only_needed_columns(spark):
    text = plan(derived.bars(spark, SF).select("symbol", "date"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"l_suppkey", "l_shipdate"}


def test_indicators_share_one_exchange(spark):
    bars = derived.bars(spark, SF)
    df = indicators.bollinger(indicators.rsi_pair(indicators.macd(bars)))
    df = indicators.kalman_zscore(indicators.anchored_vwap(df))
    text = plan(df)
    # one for the bars' own aggregate, one by symbol for all windows
    assert count(text, "Exchange hashpartitioning") == 2
    assert "Join" not in text and "Python" not in text


def test_trailing_stop_needs_no_extra_exchange(spark):
    text = plan(indicators.atr_trailing(derived.bars(spark, SF)))
    assert count(text, "Exchange hashpartitioning") == 2 and "Python" not in text and "Pandas" not in text


def test_grid_is_not_a_cross_join(spark):
    text = plan(grid.densify(derived.bars(spark, SF)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_sweep_scans_bars_once(spark):
    df = trades.merge_param_sets(
        backtest.strategy_trades(derived.bars(spark, SF), signals.TTM, filled=True)
    )
    text = plan(df)
    assert "Pandas" not in text and "Union" not in text and "SortAggregate" not in text
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_extendedprice", text)) == 1


def test_queries_never_cross_join(spark):
    from barline.catalog import QUERIES

    for name in ("portfolio_weights", "standardized_features", "period_six_months", "candidate_scores"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_filters_reach_the_scan(spark):
    df = derived.transactions(spark, SF).where(F.col("transaction_type") == "sell")
    assert "PushedFilters: [In(l_returnflag" in plan(df)


def test_squeeze_has_no_shuffle_after_the_scan(spark):
    bars = grid.densify(derived.bars(spark, SF), filled=True)
    text = plan(signals.squeeze_signals(bars, signals.strategy_params(signals.SQUEEZE)))
    own = plan(bars)
    # the windows by symbol, and what the grid itself needs
    assert count(text, "Exchange hashpartitioning") <= count(own, "Exchange hashpartitioning") + 1
    head, _, _ = text.partition("ObjectHashAggregate")
    assert "Exchange" not in head and "Window" not in head and "Pandas" not in text


def test_both_vwap_sides_share_their_sorts(spark):
    bars = derived.bars(spark, SF)
    one = count(plan(indicators.anchored_vwap(bars)), "Sort")
    both = count(plan(indicators.anchored_vwaps(bars, {"h": "highest", "l": "lowest"})), "Sort")
    assert both <= one + 1


def test_period_dates_reach_the_scan(spark):
    from barline.catalog import QUERIES

    text = plan(QUERIES["period_year_to_date"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", text)
    assert "collect_set" not in plan(QUERIES["dense_grid"](spark, SF))


def test_a_hot_lot_that_is_covered_needs_no_fold(spark):
    from barline import schemas
    from barline.operators import portfolio

    lots = spark.sql("SELECT 1L AS id, 'A' AS ticker, CAST(200000 AS DECIMAL(15,6)) AS quantity, CAST(2 AS DECIMAL(15,6)) AS purchase_price")
    requests = spark.range(100_000).select(
        F.col("id").alias("seq"), F.lit(1).cast("long").alias("position_id"),
        F.lit(2).cast(schemas.QTY).alias("quantity_to_close"), F.lit(3).cast(schemas.QTY).alias("closing_price"),
        F.lit(0).cast(schemas.FEE).alias("fees"),
    )
    done = portfolio.apply_requests(lots, requests)
    assert done.where("status = 'accepted'").count() == 100_000
    text = plan(done)
    assert re.search(r"MapInPandas", text) and "Window" not in text


def test_return_table_is_written_once_and_scanned_twice_at_most(spark):
    from barline.catalog import QUERIES

    for name in ("portfolio_tail_risk", "candidate_scores", "optimal_ef_figures", "optimize_hrp_figures"):
        # The smallest set has no symbol with a mean above the rate.
        text = plan(QUERIES[name](spark, SF.replace("0.001", "0.01")))
        assert "l_extendedprice" not in text, name
        assert len(re.findall(r"FileScan parquet \[[^\]]*ret#", text)) <= 2, name
        assert count(text, "SinglePartition") <= 3, name


def test_short_frames_compile_to_small_methods(spark):
    from barline.catalog import QUERIES

    assert largest_method(spark, lambda: QUERIES["trades_with_features"](spark, SF)) < 8000
    assert largest_method(spark, lambda: QUERIES["scored_trades_logistic"](spark, SF)) < 8000


def test_calendar_of_the_grid_needs_no_bars(spark):
    from barline.catalog import QUERIES

    for name in ("mean_return", "ttm_backtest"):
        text = plan(QUERIES[name](spark, SF))
        # the bars' own aggregate, before and after its shuffle
        assert len(re.findall(r"Aggregate\(keys=\[symbol#\d+, date#\d+\]", text)) == 2, name


def test_bars_by_symbol_group_after_the_ticks_are_dealt(spark):
    # a table of several parts
    text = plan(derived.bars_by_symbol(spark, SF.replace("0.001", "0.1")))
    assert count(text, "Exchange hashpartitioning") == 2
    # the innermost exchange carries ticks: no aggregate holds a scan's split
    _, _, below = text.rpartition("Exchange hashpartitioning")
    assert "Aggregate" not in below and "FileScan" in below


def test_scored_trades_deal_written_bars_by_their_count(spark):
    """Bars read back have lost their partitions: without an exchange of its own, each window takes a fixed number."""
    from barline.plans import features
    from barline.session import written

    sf = SF.replace("0.001", "0.01")
    bars = written(derived.dealt_bars(spark, sf), "bars")
    dealt = derived.by_symbol(spark, sf, bars, 10_000)
    at = bars.where("symbol < 'S5' and volume < 20").select("symbol", "date")
    some = features.feature_table(dealt, derived.by_symbol(spark, sf, at, 10_000))
    assert {int(n) for n in re.findall(r"Exchange hashpartitioning\(symbol#\d+, (\d+)\)", plan(some))} == {6}
    names = ["symbol", "date", "rsi_window_14", "kf_distance", "msr_rank_10"]
    kept = some.select(*names)
    want = features.feature_table(dealt).join(at, ["symbol", "date"], "left_semi").select(*names)
    assert kept.count() == want.count() > 0 and kept.exceptAll(want).count() == 0


def test_scored_backtest_deals_written_bars_by_their_count(spark, monkeypatch):
    from barline.catalog import backtests

    given = {}
    monkeypatch.setattr(
        backtests.backtest, "scored_backtest", lambda bars, small, *_, **more: given.update(bars=bars, small=small, **more)
    )
    backtests._backtest_scored(spark, SF)
    assert "REPARTITION_BY_NUM" in plan(given["bars"]) and given["seen"] is not None
    # the ticks are read for the written bars alone
    assert "l_extendedprice" not in plan(given["small"])


def test_ranks_need_one_shuffle_of_the_rows(spark):
    from barline.operators import risk

    df = spark.range(100).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    text = plan(risk.percent_rank_by(df.withColumn("s", F.floor(F.col("v") / 2)), ["g"], "v", "p", "s"))
    assert not re.search(r"Exchange hashpartitioning\([^)]*\bv#", text)
