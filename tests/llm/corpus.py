"""Small corpora for the tests, and plain versions of what the operators compute."""

import random
import re
import zlib


SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, digest string, w string, "
    "score double, node string, size bigint, rank int, start bigint, text_key string, held_out string, items string"
)
EXTRA = (1, "d", "w", 0.5, "n", 9, 9, 9, "k", "h", "i")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows_to_docs(spark, rows):
    """(doc_id, text, lang, source) rows with the other columns of documents and clashing ones."""
    full = [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(rnd, n, syllables="ka lo mi ren tos vu sha pel dor ine".split()):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def dirty_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    rnd = random.Random(5)
    base = sentence(rnd, 80)
    long = sentence(rnd, 30_000)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " more words", "en", None), (3, base + " more words", "en", None),
        (4, None, None, None), (5, "", "en", "b"), (6, " \n\t ", "en", "b"), (7, "!!! ???", None, "b"), (8, long, "de", "c"),
        (9, long + " end", "de", "c"), (None, base, "en", "a"), (None, None, None, None), (10, "Word", "fr", "é"), (11, "word", "fr", "z"),
        (12, "ÀÉ \U0001f600 straße", "de", ""), (-5, sentence(rnd, 4), "es", "b"),
    ]


def clean_rows(n=60, seed=2):
    rnd = random.Random(seed)
    return [(100 + i, sentence(rnd, rnd.randint(30, 200)), "en", "abc"[i % 3]) for i in range(n)]


def words(text):
    return WORD.findall((text or "").translate(UP))


def shingles(text, k=5):
    w = words(text)
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def held(doc_id, m, r):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % m == r


def ordered(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


