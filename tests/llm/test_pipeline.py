import random

import corpus
import pytest
import test_decontamination
import test_mixing
import test_ngram_join
import test_quality

import __spark_entry__ as entry
import corpus_pipeline
from barline.llm import quality
from barline.llm.common import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A small corpus with junk, copies, near copies and benchmark passages."""
    rnd = random.Random(12)
    rows, labels = test_quality.labelled(240, 5)
    items = [(i, corpus.sentence(rnd, 30)) for i in range(5)]
    rows += [(1000 + i, rows[i * 3][1], "en", "b") for i in range(20)]
    rows += [(2000 + i, test_ngram_join.edited(rnd, corpus.sentence(random.Random(i // 3), 150), 2), "en", None) for i in range(30)]
    rows += [(3000 + i, items[i][1] + " " + corpus.sentence(rnd, 60), "en", "c") for i in range(5)]
    path = tmp_path_factory.mktemp("corpus")
    corpus.rows_to_docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    test_quality.marks(spark, labels).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_against_brute_force(spark, sf_dir):
    path, rows, items = sf_dir
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert any(i not in good for i, *_ in rows)
    left = [r for r in rows if r[0] in good]
    last = {t: max(i for i, u, *_ in left if u == t) for _, t, *_ in left}
    left = [r for r in left if last[r[1]] == r[0]]
    classes, _ = test_ngram_join.brute(left)
    left = [r for r in left if classes[r[0]] == r[0]]
    bad = {r[0] for r in test_decontamination.brute(left, items) if r[5]}
    assert bad and bad <= {3000 + i for i in range(5)}
    left = [r for r in left if r[0] not in bad]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == {r[0] for r in left}
    order = sorted({r[3] for r in left}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(test_mixing.size_of(t) for _, t, _, x in left if x == s) for s in order}
    targets = dict(zip(order, test_mixing.plain_targets(list(sizes.values()), [1.0 + k % 3 for k in range(len(order))])))
    for i, t, _, s in left:
        assert (got[i]["size"], got[i]["source_size"]) == (test_mixing.size_of(t), sizes[s])
        assert got[i]["target"] == pytest.approx(targets[s])
        assert got[i]["taken"] <= 3 * got[i]["size"]
    for s, target in targets.items():
        assert abs(sum(got[r[0]]["taken"] for r in left if r[3] == s) - target) <= 64


@pytest.mark.parametrize("k", range(5))
def test_stages_on_dirty_and_empty_rows(spark, sf_dir, dirty, empty, k):
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, dirty, sf_dir[0])
    if k < 4:
        assert out.columns == dirty.columns
    assert 0 < out.count() <= len(corpus.dirty_rows())
    assert stage(spark, empty, sf_dir[0]).count() == 0
