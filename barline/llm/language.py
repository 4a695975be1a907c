"""Language identification by hierarchical discrimination.

Character n-grams of the whole text are hashed into one vector. A first model picks the language
family; within it, one-versus-one linear support vector machines separate the languages and vote.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import held_out, query, stored, table

#: Hashed n-grams of 1 to ORDER letters, in DIM places.
DIM, ORDER = 2048, 3
#: Labelled texts to learn from, dealt evenly over the languages. Languages with more are sampled by a
#: hash of the identifier.
MAX_TEXTS = 8000
#: Characters in a worker's memory at a time (or one text, if it is longer).
BATCH = 1 << 20
UNKNOWN = "und"

#: Fixed groups of closely related languages (ISO 639-1). A language in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "celtic": ("ga", "gd", "cy", "br"),
    "indic": ("hi", "bn", "ur", "mr", "pa", "gu", "ne"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt", "am"),
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool)
    return _letter


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of square-rooted n-gram shares, whether the text has a letter). Runs of anything
    but letters count as one blank."""
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    code = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    letter = _letters()[code]
    has = np.bincount(owner, weights=letter, minlength=len(parts)) > 0
    code = np.where(letter, code, np.uint32(32))
    # A blank after a blank goes, but every text begins with one.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[np.cumsum([0] + [len(p) for p in parts[:-1]], dtype=np.int64)[: len(parts)]] = True
    code, owner = code[keep].astype(np.uint64), owner[keep]
    out = np.zeros((len(parts), DIM), dtype=np.float64)
    for k in range(1, min(ORDER, len(code)) + 1):
        n = len(code) - k + 1
        h = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(1_000_003) + code[i : i + n]
        own = owner[:n]
        whole = own == owner[k - 1 :]
        place = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % DIM
        out += np.bincount((own * DIM + place)[whole], minlength=len(parts) * DIM).reshape(len(parts), DIM)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12), has


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        size = batch["text"].str.len().fillna(0).to_numpy().cumsum() // BATCH
        for _, part in batch.groupby(size, sort=False):
            for at in range(0, len(part), 256):
                yield part.iloc[at : at + 256]


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = MAX_TEXTS) -> DataFrame:
    """(lang, family, x) of the texts learned from."""
    own = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(~held_out(F.col("id"), 3, 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return own.select("lang").withColumn("family", F.lit("")).withColumn("x", F.array().cast("array<float>"))
    share = {lang: min(1.0, most / len(counts) / n) for lang, n in counts.items()}
    limit = F.create_map(*[F.lit(v) for lang, s in share.items() for v in (lang, int(s * 2**31))])
    chosen = own.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2**31)) < limit[F.col("lang")])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _groups(batches):
            x, has = vectors(part["text"].tolist())
            yield pd.DataFrame({"lang": part["lang"].to_numpy()[has], "x": list(x[has].astype(np.float32))})

    made = chosen.select("lang", "text").mapInPandas(make, "lang string, x array<float>")
    family = F.create_map(*[F.lit(v) for lang in counts for v in (lang, family_of(lang))])
    return made.withColumn("family", family[F.col("lang")])


def fit(texts: DataFrame) -> dict:
    """Weights of the family model and, by family, of the machines between two languages."""
    data = stored(texts, "language-texts").withColumn("v", array_to_vector("x")).drop("x").cache()
    try:
        langs = sorted(r["lang"] for r in data.select("lang").distinct().collect())
        families = sorted({family_of(x) for x in langs})
        model: dict = {"families": families, "members": {f: [x for x in langs if family_of(x) == f] for f in families}}
        if len(families) > 1:
            y = F.create_map(*[F.lit(v) for k, f in enumerate(families) for v in (f, float(k))])
            lr = LogisticRegression(featuresCol="v", labelCol="y", family="multinomial", maxIter=30, regParam=1e-4)
            got = lr.fit(data.withColumn("y", y[F.col("family")]))
            model["w"], model["b"] = got.coefficientMatrix.toArray(), got.interceptVector.toArray()
        model["pairs"] = {}
        for members in model["members"].values():
            for a, b in combinations(members, 2):
                two = data.where(F.col("lang").isin(a, b)).withColumn("y", F.when(F.col("lang") == a, 1.0).otherwise(0.0))
                got = LinearSVC(featuresCol="v", labelCol="y", maxIter=40, regParam=1e-4, standardization=False).fit(two)
                model["pairs"][a, b] = (got.coefficients.toArray(), float(got.intercept))
        return model
    finally:
        data.unpersist()


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, confidence) by row: the family's probability times the share of the votes, each
    vote weighing by its margin."""
    families, members = model["families"], model["members"]
    if not families:
        return [UNKNOWN] * len(x), np.zeros(len(x))
    if len(families) > 1:
        z = x @ model["w"].T + model["b"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
    else:
        p = np.ones((len(x), 1))
    best = p.argmax(axis=1)
    langs, score = [""] * len(x), np.zeros(len(x))
    for k, family in enumerate(families):
        rows = np.nonzero(best == k)[0]
        names = members[family]
        votes = np.zeros((len(rows), len(names)))
        for (a, b), (w, c) in model["pairs"].items():
            if a in names:
                side = 1 / (1 + np.exp(-np.clip(2 * (x[rows] @ w + c), -50, 50)))
                votes[:, names.index(a)] += side
                votes[:, names.index(b)] += 1 - side
        votes = votes / max(1, len(names) - 1) if len(names) > 1 else votes + 1.0
        top = votes.argmax(axis=1)
        for i, j in zip(rows, top):
            langs[i] = names[j]
        score[rows] = p[rows, k] * votes[np.arange(len(rows)), top]
    return langs, np.clip(score, 0, 1)


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_TEXTS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Held-out documents (crc32 of the identifier mod 3 is 1) and rows without a language are not
    learned from. Null texts and texts without a letter are ``und`` with score 0, as is everything
    where nothing can be learned. Repeated rows give repeated results; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType
    model = fit(training_texts(docs, id_col, text_col, lang_col, most))

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _groups(batches):
            x, has = vectors(part["text"].fillna("").tolist())
            langs, score = predict(model, x)
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(),
                "lang_pred": [g if ok else UNKNOWN for g, ok in zip(langs, has)],
                "score": np.where(has, score, 0.0),
            })

    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInPandas(guess, "doc_id string, lang_pred string, score double").select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        held_out(F.col("doc_id").cast(kind), 3, 1).alias("held_out"),
        "lang_pred",
        "score",
    )


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))
