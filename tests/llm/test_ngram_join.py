import random
from collections import Counter
from itertools import combinations

import corpus
import pytest

from barline.llm import ngram_join as op


def brute(rows):
    """{doc_id: class} by all pairs, and the links between distinct sets."""
    sets = [(i, corpus.shingles(t)) for i, t, *_ in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 5 * len(x & y) >= 4 * len(x | y):
            a2, b2 = root(a), root(b)
            up[max(a2, b2)] = min(a2, b2)
            if x != y:
                links[a] += 1
                links[b] += 1
    return {i: root(i) for i in up}, links


def edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = corpus.sentence(rnd, 1)
    return " ".join(w)


def test_band_choice_reaches_the_recall():
    bands, rows = op.bands_for(0.8, 0.9999, 128)
    assert bands * rows <= 128
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_against_all_pairs(spark):
    rnd = random.Random(8)
    rows = corpus.clean_rows(40)
    for k in range(12):
        base = corpus.sentence(rnd, 150)
        rows += [(1000 + 20 * k + j, edited(rnd, base, j % 7), "en", "a") for j in range(rnd.randint(2, 6))]
    want, links = brute(rows)
    got = op.near_groups(corpus.rows_to_docs(spark, rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[want[r["doc_id"]]] for r in got)
    # Distinct sets of a class link by distinct sets, so equal texts share their links.
    by_set = {}
    for i, t, *_ in rows:
        by_set.setdefault(corpus.shingles(t), []).append(i)
    assert all(bool(r["links"]) == bool(links[r["doc_id"]]) for r in got)


def test_one_large_group_is_one_class(spark):
    rnd = random.Random(9)
    base = corpus.sentence(rnd, 300)
    rows = [(i, edited(rnd, base, rnd.randint(0, 4)), "en", "a") for i in range(400)] + corpus.clean_rows(30)
    rows = [(i + 5000 if k >= 400 else i, t, a, b) for k, (i, t, a, b) in enumerate(rows)]
    want, _ = brute(rows)
    got = op.near_groups(corpus.rows_to_docs(spark, rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    # In proportion to the group, not to its pairs.
    assert sum(r["links"] for r in got) < 400 * 2 * 2 * 24 * 3


def by_sets(rows):
    """{doc_id: number of other distinct sets that are similar to the document's}."""
    sets = {i: corpus.shingles(t) for i, t, *_ in rows}
    distinct = list(set(sets.values()))
    return {i: sum(1 for y in distinct if y != x and 5 * len(x & y) >= 4 * len(x | y)) for i, x in sets.items()}


@pytest.mark.parametrize("block", [512, 16])
def test_links_are_exact_in_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK_NODES", block)
    rnd = random.Random(12)
    base = corpus.sentence(rnd, 200)
    rows = [(i, edited(rnd, base, rnd.randint(0, 4)), "en", "a") for i in range(150)]
    other = corpus.sentence(rnd, 120)
    rows += [(200 + i, edited(rnd, other, i), "en", "a") for i in range(6)]
    got = {r["doc_id"]: r["links"] for r in op.near_groups(corpus.rows_to_docs(spark, rows)).collect()}
    assert got == by_sets(rows)


def test_pairs_in_a_crowd_below_the_similarity(spark):
    """Templates of a Jaccard below 0.8 share large buckets; the few pairs above it must all be found."""
    rnd = random.Random(13)
    head = corpus.sentence(rnd, 150)
    rows = [(i, head + " " + corpus.sentence(rnd, 20), "en", "a") for i in range(250)]
    for k in range(8):
        rows.append((1000 + k, rows[20 * k][1].rsplit(" ", 3)[0] + " " + corpus.sentence(rnd, 3), "en", "a"))
    sets = [corpus.shingles(t) for _, t, *_ in rows]
    assert 0.75 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8
    want, _ = brute(rows)
    got = op.near_groups(corpus.rows_to_docs(spark, rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert {r["doc_id"]: r["links"] for r in got} == by_sets(rows)


def test_two_groups_in_shared_buckets_meet_again(spark, monkeypatch):
    """With tiny buckets limits every bucket is large, and later rounds must find what is left."""
    monkeypatch.setattr(op, "SMALL", 2)
    rnd = random.Random(10)
    base = corpus.sentence(rnd, 200)
    rows, text = [], base
    for i in range(30):  # a chain: neighbours are similar, far ones are not
        text = edited(rnd, text, 3)
        rows.append((i, text, "en", "a"))
    want, _ = brute(rows)
    got = op.near_groups(corpus.rows_to_docs(spark, rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_dirty_rows(dirty):
    got = {(r["doc_id"], r["class_id"]) for r in op.near_groups(dirty).collect()}
    assert {(1, 1), (2, 1), (8, 8), (9, 8), (None, 1), (4, 4), (5, 5), (6, 6), (7, 7), (None, None), (10, 10), (11, 10)} <= got
    assert op.near_groups(dirty).count() == len(corpus.dirty_rows())


def test_empty_table_and_stage(dirty, empty):
    assert op.near_groups(empty).count() == 0
    assert op.keep_one(empty).count() == 0
    out = op.keep_one(dirty)
    assert out.columns == dirty.columns
    ids = {r["doc_id"] for r in out.collect()}
    assert {1, 4, 5, 6, 7, 8, 10, None} <= ids
    assert not ids & {2, 9, 11}


def classes_of_rows(rows):
    """[the class of each row], by all pairs of rows."""
    sets, up = [corpus.shingles(t) for _, t, *_ in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def test_repeated_and_missing_identifiers(spark):
    rnd = random.Random(21)
    base, other, alone, third = (corpus.sentence(rnd, n) for n in (120, 100, 90, 80))
    rows = [
        (1, base, "en", "a"), (2, base + " x1", "en", "a"), (2, alone, "en", "a"),  # alone is like nothing
        (None, other, "en", "a"), (None, other + " x1", "en", "b"),  # no identifier at all in the class
        (3, third, "en", "a"), (3, third, "en", "c"), (3, third + " x2", "en", "a"), (None, third + " x3", "en", "a"),
        (4, "", "en", "a"), (4, None, "en", "a"), (4, "", "en", "a"), (None, "...", "en", "a"),
    ]
    docs = corpus.rows_to_docs(spark, rows)
    got = op.near_groups(docs).select("doc_id", "class_id", "class_size", "links").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([
        (1, 1, 2, 1), (2, 1, 2, 1), (2, 2, 1, 0), (None, None, 2, 1), (None, None, 2, 1),
        (3, 3, 4, 2), (3, 3, 4, 2), (3, 3, 4, 2), (None, 3, 4, 2),
        (4, 4, 1, 0), (4, 4, 1, 0), (4, 4, 1, 0), (None, None, 1, 0),
    ], key=repr)
    kept = [(r["doc_id"], r["text"]) for r in op.keep_one(docs).collect()]
    groups = {}
    for (i, t, *_), c in zip(rows, classes_of_rows(rows)):
        groups.setdefault(c if corpus.shingles(t) else len(groups) + 1000, []).append((i, t))
    assert len(kept) == len(groups)
    for group in groups.values():
        least = min((i is None, i or 0) for i, _ in group)
        assert sum(kept.count(m) for m in set(group) if (m[0] is None, m[0] or 0) == least) >= 1
    assert (2, alone) in kept and (1, base) in kept and (2, base + " x1") not in kept


def test_clashing_column_names(spark):
    docs = corpus.rows_to_docs(spark, corpus.dirty_rows())
    for name in ("name", "mark", "label", "rank", "best", "sha", "__name", "__node", "__gone", "count"):
        docs = docs.withColumn(name, docs["n_chars"])
    out = op.keep_one(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} >= {1, 4, 5, 6, 7, 8, 10, None}


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6])
def test_shingle_sets(n):
    import numpy as np

    s = op.shingle_set(np.arange(1, n + 1))
    assert len(s) == (0 if n == 0 else max(1, n - 4))
