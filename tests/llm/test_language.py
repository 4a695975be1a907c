import random

import corpus
import numpy as np

from barline.llm import language as op

SYLLABLES = {"en": "the ing and tion her wh".split(), "de": "sch ung der ein ü ge".split(), "fr": "eau oi que é ment le".split(), "es": "ción ado la ñ os que".split(), "xx": "кла ва дро им зе".split()}


def rows_of(n, seed=1):
    rnd = random.Random(seed)
    langs = list(SYLLABLES)
    return [(i, corpus.sentence(rnd, rnd.randint(5, 60), SYLLABLES[lang]), lang, "s") for i in range(n) for lang in [rnd.choice(langs)]]


def plain_vector(text):
    """The same n-grams, counted one by one."""
    s, out = [], np.zeros(op.DIM)
    for c in f" {text.lower()} ":
        c = ord(c) if c.isalpha() else 32
        if c != 32 or not s or s[-1] != 32:
            s.append(c)
    mask = (1 << 64) - 1
    for k in range(1, op.ORDER + 1):
        for i in range(len(s) - k + 1):
            h = k
            for c in s[i : i + k]:
                h = (h * 1_000_003 + c) & mask
            out[((h * 0x9E3779B97F4A7C15 & mask) >> 40) % op.DIM] += 1
    out = np.sqrt(out)
    return out / np.linalg.norm(out)


def test_vectors_against_plain_counts():
    texts = ["Hello, wörld!", "a", "ÉÉ é 12 3", "x" * 500, "\U0001f600 ab", " \n ", "İstanbul"]
    got, has = op.vectors(texts)
    for t, x in zip(texts, got):
        assert np.allclose(x, plain_vector(t)), t
    assert has.tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_held_out_accuracy(spark):
    rows = rows_of(600)
    got = {r["doc_id"]: r for r in op.languages(corpus.rows_to_docs(spark, rows)).collect()}
    test = [(got[i], lang) for i, _, lang, _ in rows if corpus.held(i, 3, 1)]
    assert sum(r["lang_pred"] == lang for r, lang in test) / len(test) > 0.98
    assert all(r["held_out"] == corpus.held(i, 3, 1) and 0 <= r["score"] <= 1 for i, r in got.items())


def test_held_out_languages_and_sources_change_nothing(spark):
    rows = rows_of(150)
    other = [(i, t, "de" if corpus.held(i, 3, 1) else lang, f"s{i}") for i, t, lang, _ in rows]
    cols = ("doc_id", "lang_pred")
    assert corpus.ordered(op.languages(corpus.rows_to_docs(spark, rows)), *cols) == corpus.ordered(op.languages(corpus.rows_to_docs(spark, other)), *cols)


def test_sample_bound(spark):
    docs = corpus.rows_to_docs(spark, rows_of(400))
    n = op.training_texts(docs, "doc_id", "text", "lang", 50).count()
    assert 20 <= n <= 90


def test_dirty_rows(dirty):
    got = op.languages(dirty).collect()
    assert len(got) == len(corpus.dirty_rows())
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(by[i] == op.UNKNOWN for i in (4, 5, 6, 7))
    assert all(by[i] != op.UNKNOWN for i in (1, 8, 10, 12))


def test_one_language_and_none(spark, empty):
    rows = [(i, "some words here", "en", None) for i in range(6)] + [(9, None, "en", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in op.languages(corpus.rows_to_docs(spark, rows)).collect()}
    assert got[0] == "en" and got[9] == op.UNKNOWN
    none = [(i, "some words here", None, None) for i in range(3)]
    assert {r["lang_pred"] for r in op.languages(corpus.rows_to_docs(spark, none)).collect()} == {op.UNKNOWN}
    assert op.languages(empty).count() == 0
