import math
import random
import zlib
from collections import Counter

import corpus
import numpy as np
import pytest

from barline.llm import language_model as op


def tokens(text):
    return [x.decode() for x in (text or "").translate(corpus.UP).encode().split()] + ["\n"]


def base(rows):
    c = Counter(t for i, text, *_ in rows if not corpus.held(i, 7, 2) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text, *_ in rows:
        own = tokens(text)
        score = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own)
        out.append((i, corpus.held(i, 7, 2), len(own), sum(c[t] > 0 for t in own), n, score))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


def grammar(rnd, n):
    """Text whose words depend on the word before."""
    nxt = {"the": ["cat", "dog", "sky"], "cat": ["sat,"], "dog": ["ran."], "sky": ["glows"], "sat,": ["the"], "ran.": ["the"], "glows": ["the"]}
    w, out = "the", []
    for _ in range(n):
        out.append(w if rnd.random() > 0.05 else f"odd{rnd.randint(0, 500)}")
        w = rnd.choice(nxt[w])
    return " ".join(out)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("head", [1 << 17, 5])
def test_counts_and_learning(spark, monkeypatch, head):
    monkeypatch.setattr(op, "HEAD", head)
    monkeypatch.setattr(op.head_cut, "__defaults__", (head,))
    rnd = random.Random(2)
    rows = [(i, grammar(rnd, rnd.randint(5, 120)), "en", "a") for i in range(150)]
    rows += [(i, "Ünknown Wörds in HELD texts \x1c\xa0 here", "en", "a") for i in range(150, 170)]
    got = op.document_scores(corpus.rows_to_docs(spark, rows))
    both = corpus.ordered(got, *COLUMNS, "score")
    same(sorted((r[:6] for r in both), key=repr), base(rows))
    test = [r for r in both if r[1] and r[0] < 150]
    if head > 5:
        assert sum(r[6] for r in test) > 0.85 * sum(r[5] for r in test)  # log10: closer to 0 is better
    assert all(r[6] < 0 for r in both)


def any_model(seed):
    rng = np.random.default_rng(seed)
    model = op.Model(rng.permutation(op.MODELLED), rng.random(op.MODELLED) + 0.1, rng.random(op.SHAPES) + 0.1)
    model.weights = [rng.normal(size=w.shape).astype(np.float16).astype(np.float32) for w in model.weights]
    return model


def test_probabilities_add_up():
    """Over all targets, for histories of any words."""
    model, all_targets = any_model(1), np.arange(op.MODELLED + op.SHAPES)
    rng = np.random.default_rng(2)
    codes = [0, op.BASE**3 - 1, *rng.integers(0, op.BASE**3, 8)]
    for code in codes:
        got = model(np.full(len(all_targets), code), all_targets)
        assert np.exp(got).sum() == pytest.approx(1, abs=1e-4)


def plain_score(rows, model, text):
    """The score token by token, with sums and logarithms of plain numbers."""
    c = Counter(t for i, x, *_ in rows if not corpus.held(i, 7, 2) for t in tokens(x))
    head = sorted(c, key=lambda t: (-c[t], t))
    words = {t: i for i, t in enumerate(head[: op.MODELLED]) if c[t] > 1}
    tail = head[len(words) :]
    shape = {t: op.shape_class(t.encode()) - op.OWN for t in {*tail, *tokens(text)}}
    n1, n2 = (sum(c[t] == i for t in tail) for i in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def number(t):
        return words[t] if t in words else op.MODELLED + zlib.crc32(t.encode()) % op.HASHES * op.SHAPES + shape[t]

    def class_of(h):
        if h == op.BEGIN:
            return op.CLASSES
        return model.classes[h if h < op.MODELLED else op.MODELLED + (h - op.MODELLED) % op.SHAPES]

    def share(w, bias, features, at):
        z = bias + sum(w[int(op.feature_rows(k, *[np.array([p]) for p in parts])[0])] for k, *parts in features)
        return math.log10(math.exp(z[at]) / sum(math.exp(x) for x in z))

    out, past = 0.0, [op.BEGIN] * 3
    for t in tokens(text):
        h3, h2, h1 = past[-3:]
        k = [class_of(h) for h in (h1, h2, h3)]
        own = model.classes[words[t]] if t in words else op.OWN + shape[t]
        out += share(model.weights[0], model.bias[0], [(0, h1), (1, h1, h2), (2, h2), (3, h3), (4, *k)], own)
        if t in words:
            features = [(5, own, h1), (6, own, h2), (7, own, *k[:2])]
            out += share(model.weights[1], model.bias[1][own], features, model.slots[words[t]])
        else:
            same = [x for x in tail if shape[x] == shape[t]]
            mass = sum(c[x] for x in same)
            if c[t]:
                out += math.log10((c[t] - d) / mass)
            elif same:
                out += math.log10(d * len(same) / mass)
        past.append(number(t))
    return out


@pytest.mark.parametrize("head", [1 << 17, 4200])
def test_scores_equal_a_plain_loop(spark, monkeypatch, head):
    """With given weights; tokens of word classes, of the head, of the count table and unknown ones."""
    rnd = random.Random(5)
    rows = [(i, " ".join(f"W{int(rnd.paretovariate(0.5)) % 9000}{rnd.choice(['', 'é', 'ab'])}" for _ in range(150)), "en", "a") for i in range(90)]
    rows += [(90, "", "en", "a"), (91, None, "en", "a"), (92, "nie gesehen w1", "en", "a")]
    model = any_model(7)
    monkeypatch.setattr(op.head_cut, "__defaults__", (head,))
    monkeypatch.setattr(op, "train", lambda events, _: model)
    got = {r["doc_id"]: r["score"] for r in op.document_scores(corpus.rows_to_docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows[::9] + rows[-3:]:
        assert got[i] == pytest.approx(plain_score(rows, model, text), rel=1e-5)


def test_event_counts(spark):
    rows = [(1, "a b a b"), (2, "a b a b"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, low string")
    got = {(r["code"], r["target"]): r["n"] for r in op.event_counts(docs, [b"a", b"b", b"\n"], 3).collect()}
    want = Counter()
    for _, text in rows:
        past = [op.BEGIN] * 3
        for t in [*text.split(), "\n"]:
            want[past[-1] + past[-2] * op.BASE + past[-3] * op.BASE**2, ["a", "b", "\n"].index(t)] += 1
            past.append(["a", "b", "\n"].index(t))
    assert got == want


def test_merging_in_a_tree_is_the_mean_of_those_that_moved(spark, monkeypatch):
    rows = op.ROWS // op.BLOCKS
    made = []
    for task in range(70):
        moved = np.zeros((rows, op.SLOTS), dtype=np.float16)
        moved[task % 2] = task
        mass = moved.any(axis=1).astype(np.float32)
        made.append((op.BLOCKS + 3, task, mass.tobytes(), moved.tobytes()))
    got = op._merged(spark.createDataFrame(made, op.MOVED), 70)
    assert not got[0].any()
    even, odd = [t for t in range(2, 70, 2)], [t for t in range(1, 70, 2)]
    at = 3 * rows
    assert got[1][at, 0] == pytest.approx(np.mean(even), rel=1e-2) and got[1][at + 1, 5] == pytest.approx(np.mean(odd), rel=1e-2)
    assert not got[1][:at].any() and not got[1][at + 2 :].any()


def test_words_after_the_same_words_share_a_class():
    rng = np.random.default_rng(4)
    group = rng.permutation(np.arange(op.MODELLED) % 2)
    profile = rng.random((op.MODELLED, 2 * op.CONTEXT)) * 0.1
    profile[np.arange(op.MODELLED), group * 3] += 2
    order = op.class_order(profile)
    assert sorted(order) == list(range(op.MODELLED))
    assert all(len(set(x)) == 1 for x in group[order].reshape(op.OWN, op.SLOTS))


def test_histories():
    got = op.histories(np.array([1, 2, 3, 4, 0, 7, 0]), np.array([0, 5]))
    b = op.BEGIN
    want = [(b, b, b), (1, b, b), (2, 1, b), (3, 2, 1), (4, 3, 2), (b, b, b), (7, b, b)]
    assert [tuple(int(x) for x in h) for h in zip(*op.split_history(got))] == want


def test_classes_agree_in_sql_and_python(spark):
    from pyspark.sql import functions as F

    names = ["a", "the", "été", "x\U0001f600y", "!!", "ab", "ÀB", "\x7f", "own"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = {r["t"]: r["k"] for r in df.select("t", op.class_column(F.col("t"), ["own"]).alias("k")).collect()}
    assert got == {n: 0 if n == "own" else op.shape_class(n.encode()) for n in names}


def test_dirty_and_empty(dirty, empty):
    got = op.document_scores(dirty)
    same(corpus.ordered(got, *COLUMNS), base(corpus.dirty_rows()))
    assert op.document_scores(empty).count() == 0


def test_nothing_to_learn(spark):
    held = [(i, "some text", "en", "a") for i in range(200) if corpus.held(i, 7, 2)]
    got = op.document_scores(corpus.rows_to_docs(spark, held)).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)


def test_summed_rows():
    rng = np.random.default_rng(6)
    g = rng.normal(size=(300, 5)).astype(np.float32)
    rows = np.concatenate([np.minimum(rng.geometric(0.2, 300), 40), rng.integers(0, op.ROWS, 300)])
    own, got = op.summed_rows(rows, g)
    want = np.zeros((op.ROWS, 5))
    np.add.at(want, rows, np.concatenate([g, g]))
    assert list(own) == sorted(set(rows.tolist())) and np.allclose(got, want[own], atol=1e-3)


def test_packed_events_are_small_and_whole():
    """Also keys beyond 2 ** 63, counts of many bytes, and one event."""
    rng = np.random.default_rng(8)
    for size in (1, 4000):
        codes = rng.integers(0, op.BASE**3, size)
        assert (op.history_of(op.hashed_history(codes)) == codes).all()
        key, target = op.hashed_history(codes), rng.integers(0, op.MODELLED + op.SHAPES, size).astype(np.uint16)
        n = np.where(rng.random(size) < 0.9, 1, rng.integers(1, 200, size))
        found = op.counted(np.append(key, key), np.append(target, target), np.append(n, n))
        row = dict(zip([c.split()[0] for c in op.PACKED.split(", ")], op.packed(3, *found)))
        assert sum(len(row[k]) for k in ("key", "target", "n")) <= 12 * size
        code, got, counts = op.unpacked(type("Row", (), row))
        want = Counter(zip(codes.tolist(), target.tolist()))
        assert set(zip(code.tolist(), got.tolist())) == set(want) and counts.sum() == 2 * n.sum()


def test_no_more_tasks_move_weights_than_cores_on_a_small_corpus(spark, tmp_path):
    """Each task's weights go through the shuffle, so files or partitions must not multiply them."""
    rows = [(k, op.TASK, 0, b"", b"", b"") for k in range(60)]
    spark.createDataFrame(rows, op.PACKED).repartition(60).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    got, tasks, total = op.in_tasks(events)
    assert total == 60 * op.TASK and tasks <= spark.sparkContext.defaultParallelism and got.rdd.getNumPartitions() == tasks


def test_log_share_of_far_weights():
    """Where products of exponentials vanish the logarithms are added."""
    rng = np.random.default_rng(9)
    weights = (rng.normal(size=(op.ROWS, 8)) * 40).astype(np.float32)
    rows, bias, at = [rng.integers(0, op.ROWS, 50) for _ in range(5)], rng.normal(size=8).astype(np.float32), rng.integers(0, 8, 50)
    got = op.log_share(weights, op.powers(weights), rows, bias, np.exp(bias), at)
    z = sum(weights[r].astype(np.float64) for r in rows) + bias
    want = z[np.arange(50), at] - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) - z.max(axis=1)
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-5, atol=1e-3)
