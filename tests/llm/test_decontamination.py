import hashlib
import random

import corpus

from barline.llm import decontamination as op


def brute(rows, items, window=13):
    windows = {}
    for i, t in items:
        w = corpus.words(t)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t, *_ in rows:
        w = corpus.words(t)
        hit, found = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                got = windows.get(tuple(w[s : s + k]))
                if got:
                    hit |= set(range(s, s + k))
                    found |= got
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), ids, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def cases():
    rnd = random.Random(3)
    items = [(i, corpus.sentence(rnd, rnd.choice([2, 4, 5, 12, 13, 14, 40]))) for i in range(25)]
    items += [(90, items[3][1]), (91, None), (92, ""), (93, "?!"), (94, "one"), (95, "la " * 20), (None, corpus.sentence(rnd, 20))]
    items += [(96, "Straße ÀÉ " * 9)]
    rows = corpus.dirty_rows()
    for i in range(40):
        parts = [corpus.sentence(rnd, rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            w = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, max(0, len(w) - 13))
            parts += [" ".join(w[a : a + rnd.randint(1, 40)]).upper() if i % 4 == 0 else ", ".join(w[a:]), corpus.sentence(rnd, 5)]
        rows.append((200 + i, " ".join(parts), "en", "a"))
    rows += [(300, "la " * 3000, "en", "a"), (301, "a one b", "en", "a"), (302, "straße ÀÉ " * 40, "de", "a"), (303, items[3][1], "en", "b")]
    return rows, items


def test_against_brute_force(spark):
    rows, items = cases()
    named = [(i, t) for i, t in items if i is not None]
    docs = corpus.rows_to_docs(spark, rows)
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in named], "item_id bigint, text string, len int, window string")
    got = op.contamination(op.benchmark_hits(docs, bench))
    assert corpus.ordered(got, *COLUMNS) == brute(rows, named)


def test_blocks_give_the_same(spark, monkeypatch):
    rows, items = cases()
    named = [(i, t) for i, t in items if i is not None]
    monkeypatch.setattr(op, "BLOCK", 60)
    docs = corpus.rows_to_docs(spark, rows)
    bench = spark.createDataFrame(named, "item_id bigint, text string")
    got = op.contamination(op.benchmark_hits(docs, bench))
    assert corpus.ordered(got, *COLUMNS) == brute(rows, named)


def test_empty_tables(spark, dirty, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    assert corpus.ordered(op.contamination(op.benchmark_hits(dirty, none)), *COLUMNS) == brute(corpus.dirty_rows(), [])
    assert op.contamination(op.benchmark_hits(empty, some)).count() == 0
    assert op.drop_contaminated(empty, some).count() == 0


def test_stage(spark, dirty):
    some = spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    out = op.drop_contaminated(dirty, some)
    assert out.columns == dirty.columns
    want = sorted((r[0] for r in corpus.dirty_rows() if r[0] not in (10, 11)), key=repr)
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == want


def test_no_python_in_the_plan(spark, dirty):
    some = spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    plan = op.benchmark_hits(dirty, some)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
