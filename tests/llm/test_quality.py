import random

import corpus

from barline.llm import quality as op


def labelled(n=300, seed=3):
    """Prose is good; shouted, listed or repeated words are not."""
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        t = corpus.sentence(rnd, rnd.randint(20, 200)).capitalize() + "."
        bad = rnd.random() < 0.2
        if bad:
            kind = rnd.randint(0, 3)
            w = t.split()
            t = [" ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join(x + "###" for x in w), " ".join(x for x in w for _ in range(9))][kind]
        rows.append((i, t, "en", "a"))
        if i % 3 or bad:
            labels.append((i, 0 if bad else 1))
    return rows, labels


def marks(spark, labels):
    return spark.createDataFrame([(i, q, 0, "x") for i, q in labels], "doc_id bigint, quality int, toxic int, text string")


def test_held_out_accuracy(spark):
    rows, labels = labelled(900)
    got = {r["doc_id"]: r for r in op.quality_scores(corpus.rows_to_docs(spark, rows), marks(spark, labels)).collect()}
    assert len(got) == len(rows)
    test = [(got[i], q) for i, q in labels if corpus.held(i, 3, 1)]
    assert len(test) > 100
    assert sum(r["predicted"] == q for r, q in test) / len(test) > 0.97
    for i, r in got.items():
        assert r["held_out"] == corpus.held(i, 3, 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_labels_source_and_lang_change_nothing(spark):
    rows, labels = labelled()
    first = corpus.ordered(op.quality_scores(corpus.rows_to_docs(spark, rows), marks(spark, labels)), "doc_id", "score")
    turned = [(i, 1 - q if corpus.held(i, 3, 1) else q) for i, q in labels]
    other = [(i, t, "xx", "yy") for i, t, _, _ in rows]
    second = corpus.ordered(op.quality_scores(corpus.rows_to_docs(spark, other), marks(spark, turned)), "doc_id", "score")
    assert [i for i, _ in first] == [i for i, _ in second]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(first, second))


def test_pairs_are_linear_and_prefer_the_accepted(spark):
    rows = [(i, int(i % 5 > 0), float(i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, quality int, x double")
    pairs = op.preference_pairs(df, ["x"], rounds=2).collect()
    assert 0.95 * 2 * 1600 <= len(pairs) <= 2 * 1600
    assert all(r["x"] > 0 for r in pairs)


def test_ranking_against_plain_gradient_steps(spark):
    import numpy as np

    rnd = random.Random(7)
    rows = [(i, int(rnd.random() < 1 / (1 + np.exp(-2 * x + y))), x, y) for i in range(1200) for x, y in [(rnd.gauss(0, 1), rnd.gauss(0, 1))]]
    df = spark.createDataFrame(rows, "doc_id bigint, quality int, a double, b double")
    names = ["a", "b"]
    model = op.fit(df, names)["features"]
    scaled = df.select("doc_id", "quality", *[op._scaled(c, model[c]).alias(c) for c in names])
    x = op.preference_pairs(scaled, names).toPandas().to_numpy()
    w = np.zeros(2)
    for _ in range(3000):
        w += 0.5 * (x.T @ (1 / (1 + np.exp(x @ w))) - op.RIDGE * w) / len(x)
    assert np.allclose(w, [model[c][2] for c in names], atol=1e-3)
    assert w[0] > 1 and w[1] < -0.4


def test_dirty_rows_and_missing_labels(spark, dirty, empty):
    none = marks(spark, [])
    got = op.quality_scores(dirty, none).collect()
    assert len(got) == len(corpus.dirty_rows())
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (8, 1), (8, 1), (999, 0), (10, 7)], "doc_id bigint, quality int")
    assert len(op.quality_scores(dirty, odd).collect()) == len(got)
    assert op.quality_scores(empty, odd).count() == 0


def test_stage(spark, dirty, empty):
    rows, labels = labelled()
    docs = corpus.rows_to_docs(spark, rows)
    out = op.drop_rejected(docs, marks(spark, labels))
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    scores = op.quality_scores(docs, marks(spark, labels)).collect()
    assert kept == {r["doc_id"] for r in scores if r["predicted"] == 1}
    assert op.drop_rejected(dirty, marks(spark, [])).count() == dirty.count()
    assert op.drop_rejected(empty, marks(spark, labels)).count() == 0
