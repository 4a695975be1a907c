import random

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import mixing as op


def plain_targets(sizes, weights):
    """Repeated sharing, one source closed at a time."""
    target, closed = [0.0] * len(sizes), set()
    while True:
        rest = sum(sizes) - sum(target[i] for i in closed)
        free = [i for i in range(len(sizes)) if i not in closed]
        total = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / total > 3 * sizes[i]]
        if not over:
            for i in free:
                target[i] = rest * weights[i] / total
            return target
        for i in over:
            target[i] = 3.0 * sizes[i]
            closed.add(i)


def sources_of(spark, sizes, weights):
    rows = [(k, s, float(w)) for k, (s, w) in enumerate(zip(sizes, weights))]
    return spark.createDataFrame(rows, "rank long, source_size long, weight double")


@pytest.mark.parametrize(
    "sizes",
    [[10, 10, 10], [1, 1, 1000], [0, 5, 100, 7, 3], [1000, 1, 1, 1], [0, 0], [4**k for k in range(12)]],
)
def test_targets(spark, sizes):
    weights = [1.0 + k % 3 for k in range(len(sizes))]
    got = [r["target"] for r in op.share_out(sources_of(spark, sizes, weights)).orderBy("rank").collect()]
    assert got == pytest.approx(plain_targets(sizes, weights))
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes))


def test_draws_add_up_and_vary():
    slots = [100, 0, 2500, 33]
    wanted = op.shard_sizes(sum(slots), 16)
    assert sum(wanted) == sum(slots) and max(wanted) - min(wanted) <= 1
    drawn = op.draw_shards(slots, wanted, 1)
    assert drawn.sum(axis=0).tolist() == slots and drawn.sum(axis=1).tolist() == wanted
    assert len({tuple(x) for x in drawn.tolist()}) > 8
    assert (op.draw_shards(slots, wanted, 1) == drawn).all()


def test_draws_over_more_sources_than_groups(spark):
    """Sources keep their totals and shards their size; how often a shard takes a source is multinomial."""
    n = 2 * op.GROUPS + 77
    plan = spark.range(n).select(
        F.col("id").alias("rank"), (F.col("id") % 5 * 640).alias("source_size"),
        (F.col("id") % 5 * 640).cast("double").alias("target"),
    )
    runs = op.drawn_runs(plan, 64, 8).toPandas()
    assert runs.groupby("rank")["count"].sum().to_dict() == {k: k % 5 * 10 for k in range(n) if k % 5}
    total = sum(k % 5 * 10 for k in range(n))
    by_shard = runs.groupby("shard")["count"].sum()
    assert by_shard.sum() == total and by_shard.max() - by_shard.min() <= 1
    for _, own in runs.sort_values("shard").groupby("rank"):
        assert own["begin"].tolist() == [0, *own["count"].cumsum()[:-1]]
    # A source of 40 slots gives 5 a shard. What is left after a shard varies, and each draw is from that:
    # var(x) = 5 + var(left) / shards_left ** 2, and the last shard takes what is left.
    grid = runs[runs["rank"] % 5 == 4].pivot(index="rank", columns="shard", values="count").fillna(0).to_numpy()
    want, left = [], 0.0
    for more in range(8, 1, -1):
        want.append(5 + left / more**2)
        left = (1 - 1 / more) ** 2 * left + 5
    assert grid.sum(axis=1).tolist() == [40] * len(grid)
    assert grid.mean(axis=0) == pytest.approx([5] * 8, rel=0.1)
    assert grid.var(axis=0) == pytest.approx([*want, left], rel=0.3)


def test_many_sources(spark):
    """A hot source beside thousands of small ones; ranks by code point, null last."""
    names = [f"s{i}" for i in range(2500)] + ["ü", "Z", "", None]
    rows = [(i, "a b c d e f g h", None, s) for i, s in enumerate(names)]
    rows += [(len(names) + i, "w " * 20, None, "hot") for i in range(600)]
    got = op.taken_words(corpus.rows_to_docs(spark, rows), block=4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    order = sorted({s for s in names if s is not None} | {"hot"}, key=str.encode) + [None]
    sizes = {s: 8 for s in order} | {"hot": 12_000}
    want = dict(zip(order, plain_targets([sizes[s] for s in order], [1 + k % 3 for k in range(len(order))])))
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 4 for s in order)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    for key in (0, 123456789, -5):
        i = np.arange(n, dtype=np.int64)
        got = op.permute(i, np.full(n, n), np.full(n, key, dtype=np.int64))
        assert sorted(got) == list(range(n))


def size_of(text):
    return len((text or "").encode().split())


def test_taken_words_match_the_slots(spark):
    rnd = random.Random(4)
    rows = [(i, corpus.sentence(rnd, rnd.randint(0, 300)), None, rnd.choice(["a", "b", "b", "b", None, "ü"])) for i in range(120)]
    docs = corpus.rows_to_docs(spark, rows)
    got = {r["doc_id"]: r for r in op.taken_words(docs, block=16).collect()}
    sizes = {s: sum(size_of(t) for _, t, _, x in rows if x == s) for s in ("a", "b", "ü", None)}
    targets = dict(zip(sizes, plain_targets(list(sizes.values()), [1, 2, 3, 1])))
    for i, t, _, s in rows:
        r = got[i]
        assert (r["size"], r["source_size"]) == (size_of(t), sizes[s])
        assert r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s, target in targets.items():
        assert abs(sum(got[i]["taken"] for i, _, _, x in rows if x == s) - target) <= 32
    # By hand: lay the documents out, use every drawn block.
    placed, mixed, plan = op.mix(docs, block=16)
    use = {}
    for r in op.slots(spark, plan, 16).collect():
        use[r["rank"], r["block"]] = use.get((r["rank"], r["block"]), 0) + 1
    for r in placed.collect():
        words = range(r["start"], r["start"] + r["size"])
        assert got[r["doc_id"]]["taken"] == sum(use.get((r["rank"], w // 16), 0) for w in words)
    assert max(use.values()) <= 3
    streams = {}
    for r in placed.collect():
        streams.setdefault(r["rank"], []).append((r["start"], r["size"]))
    for spans in streams.values():  # no gaps, no overlaps
        at = 0
        for start, size in sorted(x for x in spans if x[1]):
            assert start == at
            at += size


def test_dirty_rows_and_reruns(dirty):
    cols = ("doc_id", "source", "size", "source_size", "target", "taken")
    first = corpus.ordered(op.taken_words(dirty), *cols)
    assert first == corpus.ordered(op.taken_words(dirty.repartition(5)), *cols)
    want = sorted(((i, s, size_of(t)) for i, t, _, s in corpus.dirty_rows()), key=repr)
    assert sorted((r[:3] for r in first), key=repr) == want
    assert all(r[5] <= 3 * r[2] for r in first)


def test_empty_table(empty):
    assert op.taken_words(empty).count() == 0
