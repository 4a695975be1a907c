"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is a weighted sum of features of its text. Labelled documents are dealt into slots;
in each slot every rejected document meets accepted ones, and the weights are learned by logistic loss
on the feature differences of these preference pairs (Newton steps whose sums Spark makes). Documents
whose score lies below a quantile of the labelled scores, the share of rejected ones, are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import held_out, query, stored, table

#: Text features. Shares are of characters, of words, or of lines.
FEATURES = (
    "log_words", "word_length", "letters", "upper", "digits", "marks", "repeated_next", "distinct_root",
    "alone_marks", "short_words", "ends_in_mark", "line_copies", "line_words", "top_word",
)
#: Standardised features are cut to this range, so that one odd text cannot outweigh all others.
CLIP = 6.0
#: Preference pairs a labelled document of the rarer class gets.
ROUNDS = 4
#: Labelled documents in a slot.
SLOT = 64
RIDGE = 1.0
STEPS = 12


def text_features(text: str | None) -> tuple[float, ...]:
    """The features of one whole text; all zero if it has no words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    joined = "".join(words)
    chars = len(joined)
    upper = letters = digits = 0
    # Counting by distinct character is faster than by character.
    counts = _char_counts(joined)
    for c, k in counts:
        if c.isalpha():
            letters += k
            upper += k * c.isupper()
        elif c.isdigit():
            digits += k
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    again = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    alone = ends = short = 0
    for w, k in distinct.items():
        if not w[-1].isalnum():
            ends += k
            if len(w) < 4 and not any(map(str.isalnum, w)):
                alone += k
        if len(w) < 4:
            short += k
    return (
        float(np.log1p(n)),
        chars / n,
        letters / chars,
        upper / max(1, letters),
        digits / chars,
        (chars - letters - digits) / chars,
        again / max(1, n - 1),
        len(distinct) / n**0.75,
        alone / n,
        short / n,
        ends / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        max(distinct.values()) / n,
    )


def _char_counts(s: str) -> list[tuple[str, int]]:
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(codes) if codes.max() < 0x3000 else None
    if counts is None:
        values, n = np.unique(codes, return_counts=True)
        return [(chr(c), int(k)) for c, k in zip(values, n)]
    return [(chr(c), int(counts[c])) for c in np.nonzero(counts)[0]]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and one column per feature of each row."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = pd.DataFrame([text_features(t) for t in batch["text"]], columns=list(FEATURES), dtype=float)
            made.insert(0, "text_key", batch["text_key"].to_numpy())
            made.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield made

    kind = docs.schema[id_col].dataType
    own = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        F.col(text_col).cast("string").alias("text"),
    )
    schema = "doc_id string, text_key bigint, " + ", ".join(f"{c} double" for c in FEATURES)
    return own.mapInPandas(measure, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def preference_pairs(labelled: DataFrame, names=FEATURES, rounds: int = ROUNDS) -> DataFrame:
    """Differences (accepted less rejected) of labelled rows (doc_id, quality, features). Each round
    deals all rows into slots anew; in a slot, accepted number i meets rejected number i mod their
    count, so the pairs are as many as the accepted rows, not as the products."""
    n = labelled.count()
    slot = F.pmod(F.xxhash64("doc_id", F.col("round")), F.lit(max(1, n // SLOT)))
    dealt = labelled.withColumn("round", F.explode(F.array([F.lit(r) for r in range(rounds)]))).withColumn("slot", slot)
    place = Window.partitionBy("round", "slot", "quality").orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id")
    losers = F.sum(1 - F.col("quality")).over(Window.partitionBy("round", "slot"))
    dealt = dealt.withColumn("nth", F.row_number().over(place) - 1).withColumn("losers", losers)
    up = dealt.where("quality = 1 and losers > 0").withColumn("nth", F.col("nth") % F.col("losers"))
    down = dealt.where("quality = 0").select("round", "slot", "nth", *[F.col(c).alias(f"less_{c}") for c in names])
    return up.join(down, ["round", "slot", "nth"]).select(*[(F.col(c) - F.col(f"less_{c}")).alias(c) for c in names])


def _newton_sums(pairs: DataFrame, names, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss, one row of sums per partition."""
    d = len(names)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d + d * d)
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            p = 1 / (1 + np.exp(np.clip(x @ weights, -500, 500)))
            total[:d] += x.T @ p
            total[d:] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    got = pairs.select(*names).mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(d + d * d)
    for row in got:
        total[row["i"]] = row["v"]
    return total[:d], total[d:].reshape(d, d)


def fit(labelled: DataFrame, names=FEATURES) -> dict:
    """Model of rows (doc_id, quality, features): per feature centre, scale and weight, and the
    threshold. Without both classes all weights are zero and nothing is rejected."""
    stats = labelled.agg(
        F.count("*").alias("n"),
        F.sum(1 - F.col("quality")).alias("bad"),
        *[F.mean(c).alias(f"m_{c}") for c in names],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in names],
    ).first()
    n, bad = stats["n"] or 0, stats["bad"] or 0
    model = {c: (stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 1.0, 0.0) for c in names}
    if not 0 < bad < n:
        return {"features": model, "threshold": 0.0}
    scaled = labelled.select("doc_id", "quality", *[_scaled(c, model[c]).alias(c) for c in names])
    pairs = stored(preference_pairs(scaled, names), "pairs")
    w = np.zeros(len(names))
    for _ in range(STEPS):
        gradient, curvature = _newton_sums(pairs, names, w)
        step = np.linalg.solve(curvature + RIDGE * np.eye(len(w)), gradient - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-4 * (1 + np.abs(w).max()):
            break
    model = {c: (*model[c][:2], float(v)) for c, v in zip(names, w)}
    raw = labelled.select(raw_score({"features": model}).alias("s"))
    # Between the last rejected and the first accepted place of the sorted scores.
    share = min(1.0, max(0.0, (bad - 0.5) / max(1, n - 1)))
    threshold = raw.agg(F.expr(f"percentile(s, {share!r})").alias("t")).first()["t"]
    return {"features": model, "threshold": float(threshold)}


def _scaled(c: str, model: tuple) -> Column:
    centre, scale, _ = model
    x = (F.col(c) - F.lit(centre)) / F.lit(scale or 1.0)
    return F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x))


def raw_score(model: dict) -> Column:
    total = F.lit(0.0)
    for c, m in model["features"].items():
        total = total + _scaled(c, m) * F.lit(m[2])
    return total


def score(made: DataFrame, model: dict) -> DataFrame:
    """Add score (0 to 1; 0.5 at the threshold) and predicted to rows with features."""
    above = raw_score(model) - F.lit(model["threshold"])
    return made.withColumn("score", 1 / (1 + F.exp(-above))).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, held_out, score, predicted.

    Labels of held-out documents (crc32 of the identifier mod 3 is 1) are not learned from, nor are
    missing labels and labels without a document; of contradicting labels the lowest counts, and of
    texts that share a labelled identifier one. Null and empty texts have a score as well. An empty
    table gives an empty result; other columns of either table are not looked at.
    """
    made = stored(features(docs, id_col, text_col), "features")
    marks = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    one = made.groupBy("doc_id").agg(F.min(F.struct("text_key", *FEATURES)).alias("f")).select("doc_id", "f.*")
    labelled = stored(one.join(marks, "doc_id"), "labelled")
    return score(made, fit(labelled)).select(
        "doc_id", "text_key", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted"
    )


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    bad = (
        quality_scores(docs, labels)
        .where("predicted = 0")
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
        .distinct()
    )
    same = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__key"])
    return docs.join(bad, same, "left_anti")


@query("op1_quality")
def op1_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")
