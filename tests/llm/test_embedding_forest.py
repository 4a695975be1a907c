import math

import numpy as np
import pytest

from barline.llm import embedding_forest as op

SCHEMA = "vec_id bigint, embedding array<{}>, label int, node string, raw string, leaf int, n_links string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "n", "r", 2, "l") for i, v in rows], SCHEMA.format(kind))


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=0.95):
    """[(vec_id, n_links, component_id, kept)] by comparing everything."""
    units = []
    for _, v in rows:
        x = np.array(v, dtype=float) if good(v) else None
        units.append(None if x is None else x / np.linalg.norm(x))
    n, up = len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            x, y = units[i], units[j]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= cosine:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(least.get(root(i), v), v)
    return sorted(((v, links[i], c := least.get(root(i)), v == c) for i, (v, _) in enumerate(rows)), key=repr)


def clouds(rng, dim, sizes, spread):
    out = []
    for n in sizes:
        centre = rng.standard_normal(dim)
        out += [(centre + spread * rng.standard_normal(dim)).tolist() for _ in range(n)]
    return out


def got(df, **kw):
    return sorted((tuple(r) for r in op.near_vectors(df, **kw).collect()), key=repr)


def numbered(vectors, kind=np.float32):
    return [(i, [float(kind(x)) for x in v]) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_unusual_vectors(spark, kind):
    rng = np.random.default_rng(1)
    cast = np.float32 if kind == "float" else np.float64
    rows = numbered(clouds(rng, 8, [6, 5, 1, 1], 0.1), cast)
    rows += [(50, None), (51, []), (52, [0.0] * 8), (53, [1.0, None] * 4), (54, [float("nan")] + [1.0] * 7), (55, [float("inf")] * 8)]
    # Copies, a repeated identifier, missing identifiers, other lengths, tiny and huge vectors, negative zeros.
    rows += [(60, rows[0][1]), (60, rows[7][1]), (None, rows[1][1]), (None, [5.0] * 8), (None, None)]
    rows += [(70, [1.0, 0.0]), (71, [2.0, -0.0]), (72, [1.0] * 9), (73, [1e-30, 0.0]), (74, [1e30, 0.0])]
    assert got(table(spark, rows, kind)) == brute(rows)
    assert got(table(spark, rows, kind), leaf_size=4) == brute(rows)


def test_small_leaves_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = clouds(rng, 64, [1] * 150 + [5] * 10, 0.02) + clouds(rng, 64, [120, 60], 0.06)
    # Chains: neighbours link, the ends do not.
    step = rng.standard_normal((2, 64))
    vectors += [(math.cos(k * 0.3) * step[0] / np.linalg.norm(step[0]) + math.sin(k * 0.3) * step[1] / np.linalg.norm(step[1])).tolist() for k in range(12)]
    rows = numbered(vectors)
    want = brute(rows)
    assert got(table(spark, rows)) == want
    monkeypatch.setattr(op, "BLOCK", 16)
    monkeypatch.setattr(op, "COLUMNS", 3)
    assert got(table(spark, rows), leaf_size=24, trees=10) == want


def test_a_third_alike(spark):
    rng = np.random.default_rng(3)
    same = rng.standard_normal(16).tolist()
    rows = numbered([same] * 300 + clouds(rng, 16, [1] * 500, 0.0) + clouds(rng, 16, [200], 0.001))
    assert got(table(spark, rows), leaf_size=64) == brute(rows)


def test_pairs_right_at_the_threshold_are_found(spark):
    """Recall against brute force over pairs of a cosine just above 0.95, in seven levels of splits."""
    rng = np.random.default_rng(4)
    rows, angle = [], math.acos(0.9501)
    for k in range(1500):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (math.cos(angle) * a + math.sin(angle) * b).tolist())]
    found = op.near_vectors(table(spark, rows, "double"), leaf_size=24).where("n_links > 0").count()
    assert found >= 0.99 * len(rows)


def test_empty_table(spark):
    df = op.near_vectors(table(spark, []))
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"] and df.collect() == []


def test_links_that_meet_elsewhere():
    met = [np.array(m) for m in ([1, 2], [2, 3], [4], [1, 4], [])]
    links = np.array([[0, 1], [0, 2], [0, 3], [2, 3], [1, 4]])
    assert op.shared_less(met, links).tolist() == [[0, 2], [1, 4]]
