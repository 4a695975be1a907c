import hashlib
import random
from collections import Counter

import corpus
import pytest

from barline.llm import exact_dedup as op


def brute(rows, largest=True):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out, seen = [], set()
    for i, t, *_ in rows:
        t = t or ""
        ids = [x for x in groups[t] if x is not None]
        keep = (max(ids) if largest else min(ids)) if ids else None
        kept = i == keep and (t, i) not in seen
        seen.add((t, i))
        out.append((i, keep, len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("largest", [True, False])
def test_dirty_rows(dirty, largest):
    assert corpus.ordered(op.exact_groups(dirty, largest=largest), *COLUMNS) == brute(corpus.dirty_rows(), largest)


def test_large_group_and_many_partitions(spark):
    rnd = random.Random(1)
    rows = [(i, "same" if i % 3 == 0 else f"text {rnd.randint(0, 400)}", None, None) for i in range(1500)]
    df = corpus.rows_to_docs(spark, rows).repartition(13)
    assert corpus.ordered(op.exact_groups(df), *COLUMNS) == brute(rows)


def test_empty_table(empty):
    assert op.exact_groups(empty).count() == 0
    assert op.drop_copies(empty).count() == 0


def test_stage_keeps_one_row_per_text(dirty):
    out = op.drop_copies(dirty)
    assert out.columns == dirty.columns
    texts = Counter(r["text"] or "" for r in out.collect())
    assert set(texts) == {t or "" for _, t, *_ in corpus.dirty_rows()}
    assert max(texts.values()) == 1


def test_null_beside_empty_and_missing_identifiers(spark):
    rows = [(5, None, "en", "a"), (5, "", "en", "b"), (None, "t", "en", "a"), (None, "t", "en", "b"), (6, "u", "en", "a"), (None, "u", "en", "a")]
    docs = corpus.rows_to_docs(spark, rows).withColumnRenamed("part", "sha").withColumnRenamed("w", "row")
    assert corpus.ordered(op.exact_groups(docs), *COLUMNS) == brute(rows)
    out = op.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in out.where("doc_id is not null").collect()) == [(5, ""), (6, "u")]
    assert out.where("doc_id is null").count() == 1


def test_rows_without_an_identifier_are_split(spark):
    df = spark.range(3000).selectExpr("cast(null as bigint) doc_id", "'same' text", "'en' lang", "'a' source")
    groups = op.exact_groups(df.repartition(7))
    assert groups.where("kept").count() == 1 and groups.where("group_size = 3000 and keep_id is null").count() == 3000
