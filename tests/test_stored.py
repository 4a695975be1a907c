"""Bucketed bars, keyed tables that are merged into, and global row numbers."""

import os
import re
import uuid

import helpers
import pytest
from pyspark.sql import functions as F

from barline.functions.series import with_rn
from barline.operators import pages, tables
from barline.plans.indicators import Spec, with_indicators
from barline.session import checkpoint_dir
from barline.sources import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folder(spark):
    return f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"


#: Indicators of plain frames, and those that re-sort for decays or folds.
FRAMES = [Spec("bbands"), Spec("sma"), Spec("stoch"), Spec("yz_volatility")]
OTHERS = [Spec("rsi"), Spec("macd"), Spec("atr_trailing"), Spec("kalman_zscore"), Spec("vwap")]


def by_day(df, columns):
    return [tuple(r) for r in df.select(*columns).orderBy("symbol", "date").collect()]


def test_bucketed_bars_need_no_shuffle_and_no_sort(spark):
    bars = helpers.bars(spark, {f"S{i}": helpers.ohlcv(90, seed=i) for i in range(40)}, parts=7)
    name, path = f"bars_{uuid.uuid4().hex}", folder(spark)
    stored.write_bucketed(bars, name, path, 8)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 8
    own = stored.read_bucketed(spark, name)
    text = plan(with_indicators(own, FRAMES))
    assert "Exchange" not in text and not re.search(r"\bSort\b", text)
    assert "Exchange" not in plan(with_indicators(own, OTHERS))
    want = with_indicators(bars, FRAMES + OTHERS)
    assert by_day(with_indicators(own, FRAMES + OTHERS), want.columns) == by_day(want, want.columns)
    # The same files under another name, as a later session would see them.
    other = f"bars_{uuid.uuid4().hex}"
    stored.attach_bucketed(spark, other, path, bars.schema, 8)
    again = stored.read_bucketed(spark, other)
    text = plan(with_indicators(again, FRAMES))
    assert "Exchange" not in text and not re.search(r"\bSort\b", text)
    assert by_day(again, bars.columns) == by_day(bars, bars.columns)


def test_bars_appended_to_buckets_are_sorted_again(spark):
    bars = with_rn(helpers.bars(spark, {f"S{i}": helpers.ohlcv(30, seed=i) for i in range(9)}))
    name, path = f"bars_{uuid.uuid4().hex}", folder(spark)
    stored.write_bucketed(bars.where("rn < 20"), name, path, 4)
    bars.where("rn >= 20").repartition(4, "symbol").write.mode("append").option("path", path).bucketBy(
        4, "symbol"
    ).sortBy("symbol", "rn").saveAsTable(name)
    got = with_indicators(stored.read_bucketed(spark, name), [Spec("macd"), Spec("stoch")])
    want = with_indicators(bars, [Spec("macd"), Spec("stoch")])
    assert "Exchange" not in plan(got) and re.search(r"\bSort\b", plan(got))
    assert by_day(got, want.columns) == by_day(want, want.columns)


SCHEMA = "id long, name string, n int"


def files(path):
    return {
        os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns
        for at, _, found in os.walk(path)
        for f in found
        if f.endswith(".parquet")
    }


def plain_merge(old, rows, insert):
    out = dict(old)
    for i, _, name in sorted(rows, key=lambda r: r[1]):
        if i in out:
            out[i] = (name, out[i][1])
        elif insert:
            out[i] = (name, None)
    return out


@pytest.mark.parametrize("insert", [False, True])
def test_merge_rewrites_touched_parts_only(spark, insert):
    old = {i: (f"n{i}", i % 7) for i in range(500)}
    df = spark.createDataFrame([(i, *v) for i, v in old.items()], SCHEMA)
    path = folder(spark)
    stored.write_keyed(df, path, ["id"], 32)
    before = files(path)
    edits = [(3, 1, "first"), (3, 2, "last"), (44, 1, None), (900, 1, "new")]
    rows = spark.createDataFrame(edits, "id long, seq int, name string")
    edit = (lambda a, b: tables.upsert(a, b, ["id"], "seq")) if insert else (
        lambda a, b: tables.replace_by_key(a, b, "seq")
    )
    changed = stored.merge_keyed(spark, path, df.schema, rows, ["id"], edit, 32)
    got = {r["id"]: (r["name"], r["n"]) for r in stored.read_keyed(spark, path, df.schema).collect()}
    assert got == plain_merge(old, edits, insert)
    parts = {r[0] for r in stored.with_part(rows, ["id"], 32).where("id < 900" if not insert else "true").select("part").collect()}
    assert set(changed) == parts
    after = files(path)
    own = {f: t for f, t in before.items() if not any(f"/part={p}/" in f for p in changed)}
    assert own and all(after.get(f) == t for f, t in own.items())
    # Again: nothing is written.
    assert stored.merge_keyed(spark, path, df.schema, rows, ["id"], edit, 32) == []
    assert files(path) == after


def test_merge_of_nothing_and_into_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    path = folder(spark)
    stored.write_keyed(empty, path, ["id"], 4)
    rows = spark.createDataFrame([(1, 1, "a"), (None, 1, "b")], "id long, seq int, name string")
    edit = lambda a, b: tables.upsert(a, b, ["id"], "seq")
    assert stored.merge_keyed(spark, path, empty.schema, rows.limit(0), ["id"], edit, 4) == []
    stored.merge_keyed(spark, path, empty.schema, rows, ["id"], edit, 4)
    got = stored.read_keyed(spark, path, empty.schema).collect()
    assert sorted(((r["id"], r["name"], r["n"]) for r in got), key=repr) == [(1, "a", None), (None, "b", None)]


def test_numbers_and_pages(spark):
    rows = [(i, (i * 7919) % 50 if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k int").repartition(5)
    order = [F.col("k").desc_nulls_last(), F.col("id")]
    want = [i for i, k in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    index = pages.numbered(df, order)
    got = {r["number"]: r["id"] for r in index.numbers().collect()}
    assert [got[n] for n in range(len(rows))] == want
    for number in (0, 1, 37, 119, 120, 500):
        page = index.page(number, 25)
        assert [r["id"] for r in page.orderBy(*order).collect()] == want[25 * number : 25 * number + 25]
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(_id", plan(index.page(37)))
    assert "Window" not in plan(index.page(37))
    assert pages.numbered(df.limit(0), order).numbers().count() == 0


def test_pages_by_key(spark):
    rows = [(i, (i * 7919) % 13) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k int")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    seen, after = [], None
    while page := [(r["k"], r["id"]) for r in pages.next_page(df, [("k", True), ("id", False)], after, 32).collect()]:
        seen += [(i, k) for k, i in page]
        after = list(page[-1])
    assert seen == want
