import math
import random
import re
from collections import Counter

import corpus
import numpy as np
import pytest

from barline.llm import lexical_search as op

ITEMS = "item_id bigint, text string, rank int, score double, doc_id string, terms int"


def terms(text):
    return re.findall(op.TERM, (text or "").translate(corpus.UP))


def brute(docs, items, top=50):
    """[(item, rank, doc_id, score)] by scoring everything; docs are (doc_id, text), items {item: texts}."""
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [c for c in counted if c[2]]
    n_all, long = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, tf, _ in counted for t in tf)
    out = []
    for item, texts in items.items():
        wanted = {t for text in texts for t in terms(text)}
        scored = []
        for i, tf, n in counted:
            m = 50 + 50 * n * n_all // long
            score = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
                for t in wanted
                if t in tf
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=repr)


def run(spark, rows, items, **kw):
    docs = corpus.rows_to_docs(spark, rows)
    bench = spark.createDataFrame([(i, t, 1, 0.5, "x", 3) for i, t in items], ITEMS)
    got = op.ranked(docs, bench, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def grouped(items):
    out = {}
    for i, t in items:
        out.setdefault(i, []).append(t)
    return out


@pytest.mark.parametrize("block,bucket,top", [(10**9, 2048, 50), (30, 7, 3)])
def test_against_scoring_everything(spark, monkeypatch, block, bucket, top):
    monkeypatch.setattr(op, "BLOCK_CHARS", block)
    monkeypatch.setattr(op, "BUCKET", bucket)
    rnd = random.Random(3)
    rows = corpus.dirty_rows() + corpus.clean_rows(80)
    # A third of all rows alike: ties by doc_id, and rows that repeat an identifier.
    same = corpus.sentence(rnd, 40)
    rows += [(5000 + i % 50, same, "en", "a") for i in range(60)]
    items = [(i, corpus.sentence(rnd, 12)) for i in range(5)]
    items += [(9, same), (10, None), (11, ""), (12, "Word, WORD? word"), (12, rows[0][1]), (None, "ka lo"), (13, "nowhereatall")]
    want = brute([(r[0], r[1]) for r in rows], grouped(items), top)
    assert run(spark, rows, items, top=top) == want
    assert any(a[3] == b[3] for a, b in zip(want, want[1:]))


def test_whole_long_texts_and_unicode(spark):
    rnd = random.Random(4)
    end = "straße Ünique"
    rows = [(1, corpus.sentence(rnd, 60_000) + " " + end, "de", "a"), (2, "STRASSE ünique", "de", "a"), (3, "x", "de", "a")]
    items = [(1, "straße"), (2, "Ünique"), (3, "ünique")]
    got = run(spark, rows, items)
    assert got == brute([(r[0], r[1]) for r in rows], grouped(items))
    assert [r[2] for r in got] == [1, 1, 2]


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "a b", 1, 0.5, "x", 3)], ITEMS)
    assert op.ranked(empty, bench).collect() == []
    docs = corpus.rows_to_docs(spark, [(1, "a b", "en", "a")])
    assert op.ranked(docs, bench.where("false")).collect() == []
    assert op.ranked(docs, spark.createDataFrame([(1, "zz", 1, 0.5, "x", 3)], ITEMS)).collect() == []


def test_a_bucket_finds_all_and_prunes():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(500):
        t = np.sort(rng.choice(200, rng.integers(1, 30), replace=False))
        rows.append((str(i), t, rng.integers(1, 1000, len(t))))
    bucket = op.Bucket(rows)
    for _ in range(50):
        t = rng.choice(260, 12, replace=False)
        w = np.sort(rng.integers(0, 9000, 12))[::-1].copy()
        scores = [sum(int(w[list(t).index(x)]) * int(v) for x, v in zip(r[1], r[2]) if x in t) for r in rows]
        for beat in (1, sorted(scores)[-20], max(scores), max(scores) + 1):
            for focus in (0, 4, 12):
                got = dict(bucket.search(t, w, focus, max(1, beat)))
                assert got == {i: s for i, s in enumerate(scores) if s >= max(1, beat)}
    assert bucket.search(t, w, 4, int(np.linalg.norm(w) * bucket.longest * 1.01)) == []
