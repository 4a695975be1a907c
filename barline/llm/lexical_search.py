"""Ranked lexical search by norm buckets.

A document is a vector of the impacts of its terms, an item a vector of the weights of its terms, and a score
is their product. Vectors are dealt over the cluster in the order of their lengths, longest first, and cut
into buckets. For an item with a known score to beat, Cauchy and Schwarz rule out every bucket whose longest
vector is too short. In the others the coordinates of the item's heaviest terms are read, and the lengths of
what remains of both vectors bound the rest of the product; only vectors whose bound reaches the score to beat
are scored, in whole numbers. The longest vectors are searched first: what they yield is the score to beat
elsewhere, so most buckets give few rows.

Items are searched in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import ascii_lower, query, stored, table

#: What separates terms once A-Z are lower-cased.
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
SCALE, LEAN, SATURATION = 1_000_000_000, 50, 20
#: Characters of item text that are searched at a time (or one item, if it is longer).
BLOCK_CHARS = 4_000_000
#: Vectors in a bucket.
BUCKET = 2048
#: Part of the documents, the longest vectors, that sets the scores to beat for the others.
LEAD = 0.02
#: Part of the square of an item's length that its heaviest terms hold, whose coordinates are read.
FOCUS = 0.8


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[dict]:
    """{item: its distinct terms} of consecutive items, as many as fit in a block. One block is on the driver
    at a time."""
    terms = F.array_distinct(F.array_remove(F.split(ascii_lower(F.col(text_col)), NOT_TERM), ""))
    rows = items.select(F.col(id_col).alias("item"), terms.alias("terms")).orderBy("item")
    block, size, last = {}, 0, object()
    for item, found in rows.toLocalIterator():
        if item != last and size >= BLOCK_CHARS:
            yield block
            block, size = {}, 0
        block[item] = sorted({*block.get(item, ()), *found})
        size += sum(map(len, found))
        last = item
    if block:
        yield block


def term_vectors(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of those in the vocabulary), tfs; documents without a
    term are left out."""
    number = {t: i for i, t in enumerate(vocabulary)}
    find = re.compile(TERM).findall

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                words = find(text)
                if words:
                    tf: dict[int, int] = {}
                    for w in words:
                        i = number.get(w)
                        if i is not None:
                            tf[i] = tf.get(i, 0) + 1
                    out.append((doc, len(words), list(tf), list(tf.values())))
            yield pd.DataFrame(out, columns=["doc_id", "n", "terms", "tfs"])

    lowered = docs.select(F.col(id_col).cast("string").alias("doc_id"), ascii_lower(F.col(text_col)).alias("text"))
    return lowered.mapInPandas(count, "doc_id string, n long, terms array<int>, tfs array<long>")


class Bucket:
    """Impact vectors of similar length, by term."""

    def __init__(self, rows: list[tuple]):
        sizes = [len(r[1]) for r in rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        terms = np.concatenate([np.asarray(r[1], dtype=np.int64) for r in rows])
        impacts = np.concatenate([np.asarray(r[2], dtype=np.int64) for r in rows])
        order = np.argsort(terms, kind="stable")
        self.docs = [r[0] for r in rows]
        self.owner, self.impacts = owner[order], impacts[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(starts, len(terms))
        self.squares = np.bincount(owner, weights=impacts.astype(np.float64) ** 2, minlength=len(rows))
        self.longest = float(np.sqrt(self.squares.max()))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.terms, term)
        if at == len(self.terms) or self.terms[at] != term:
            return self.owner[:0], self.impacts[:0]
        part = slice(self.starts[at], self.starts[at + 1])
        return self.owner[part], self.impacts[part]

    def search(self, terms: np.ndarray, weights: np.ndarray, focus: int, beat: int) -> list[tuple[int, int]]:
        """(place, score) of all vectors that score ``beat`` (at least 1) or more. Terms come heaviest first."""
        length = float(np.sqrt((weights.astype(np.float64) ** 2).sum()))
        slack = 1 + 1e-9
        if length * self.longest * slack < beat:
            return []
        n = len(self.docs)
        score, read = np.zeros(n, dtype=np.int64), np.zeros(n)
        for t, w in zip(terms[:focus].tolist(), weights[:focus].tolist()):
            owner, impact = self.postings(t)
            score[owner] += w * impact
            read[owner] += impact.astype(np.float64) ** 2
        rest = float(np.sqrt((weights[focus:].astype(np.float64) ** 2).sum()))
        bound = score + rest * np.sqrt(np.maximum(self.squares - read, 0.0) + 1e-6 * self.squares)
        alive = bound * slack >= beat
        if not alive.any():
            return []
        for t, w in zip(terms[focus:].tolist(), weights[focus:].tolist()):
            owner, impact = self.postings(t)
            kept = alive[owner]
            score[owner[kept]] += w * impact[kept]
        return [(int(i), int(score[i])) for i in np.nonzero(alive & (score >= beat))[0]]


def focus_of(weights: np.ndarray, part: float = FOCUS) -> int:
    squares = np.cumsum(weights.astype(np.float64) ** 2)
    return int(np.searchsorted(squares, part * squares[-1])) + 1 if len(weights) else 0


def _id_order(doc: str | None, whole: bool):
    # A missing identifier comes last.
    return (doc is None, (int(doc) if whole else doc) if doc is not None else 0)


def search_buckets(vectors: DataFrame, queries: dict, beat: dict, top: int, whole: bool) -> DataFrame:
    """item (its place in ``queries``), doc_id, score: of each task's vectors the ``top`` best of each item and
    what equals or beats ``beat``."""
    plan = [(k, terms, weights, focus_of(weights)) for k, (terms, weights) in queries.items()]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The worst of the best is on top of a heap, so both parts of its order are turned round.
        best: dict[int, list] = {k: [] for k in queries}
        for batch in batches:
            rows = list(batch.itertuples(index=False, name=None))
            for at in range(0, len(rows), BUCKET):
                bucket = Bucket(rows[at : at + BUCKET])
                for k, terms, weights, focus in plan:
                    heap = best[k]
                    least = max(1, beat.get(k, 1), heap[0][0] if len(heap) == top else 1)
                    for place, score in bucket.search(terms, weights, focus, least):
                        missing, number = _id_order(bucket.docs[place], whole)
                        entry = (score, _Last((missing, number)), bucket.docs[place])
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif heap[0][:2] < entry[:2]:
                            heapq.heapreplace(heap, entry)
        out = [(k, doc, score) for k, heap in best.items() for score, _, doc in heap]
        yield pd.DataFrame(out, columns=["item", "doc_id", "score"])

    return vectors.select("doc_id", "terms", "impacts").mapInPandas(find, "item int, doc_id string, score long")


class _Last:
    """Orders the other way round."""

    __slots__ = ("key",)

    def __init__(self, key):
        self.key = key

    def __lt__(self, other):
        return other.key < self.key

    def __eq__(self, other):
        return other.key == self.key


def ranked(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The ``top`` best rows of ``docs`` for each item: item_id, rank, doc_id, score.

    Scores are above 0; equal ones go by ascending doc_id, a missing one last. Null and empty texts have no
    terms and score nowhere. Rows of one item_id are one item with the terms of all of them. A row that repeats a
    doc_id is a document of its own. Empty tables give an empty result; other columns are not looked at. Only
    scores of one block of items and the weights of its terms are on the driver.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    whole = kind.typeName() in ("byte", "short", "integer", "long")
    found, totals = [], None
    for block in item_blocks(items, item_col, item_text_col):
        vocabulary = sorted({t for terms in block.values() for t in terms})
        counted = stored(term_vectors(docs, vocabulary, id_col, text_col), "term-vectors")
        totals = totals or counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, n_terms = totals
        if not n_docs:
            break
        df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        # A row for each term of the block at most.
        weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
        weights = {r[0]: r[1] for r in df.select("term", weight.alias("w")).collect()}
        queries, names = {}, list(block)
        number = {t: i for i, t in enumerate(vocabulary)}
        for k, item in enumerate(names):
            known = sorted(((weights[number[t]], number[t]) for t in block[item] if number[t] in weights), reverse=True)
            if known:
                pairs = np.array(known, dtype=np.int64)
                queries[k] = (pairs[:, 1], pairs[:, 0])
        if not queries:
            continue
        m = F.expr(f"{100 - LEAN}L + ({LEAN}L * n * {n_docs}L) div {n_terms}L")
        impacts = F.expr(f"transform(tfs, x -> ({SCALE}L * x) div (1000L * x + {SATURATION}L * m))")
        square = F.expr("aggregate(impacts, 0D, (s, x) -> s + cast(x as double) * x)")
        vectors = (
            counted.where("size(terms) > 0")
            .withColumn("m", m)
            .select("doc_id", "terms", impacts.alias("impacts"))
            .withColumn("length", F.sqrt(square))
        )
        by_length = stored(
            # Copies are equally long: the identifier splits them.
            vectors.repartitionByRange(F.col("length").desc(), F.xxhash64("doc_id")).sortWithinPartitions(F.col("length").desc()),
            "by-length",
        )
        cut = by_length.agg(F.percentile_approx("length", 1 - LEAD, 1000)).first()[0]
        ahead = F.col("length") >= cut
        lead = stored(search_buckets(by_length.where(ahead), queries, {}, top, whole), "lead")
        last = Window.partitionBy("item").orderBy(F.col("score").desc())
        beat = lead.withColumn("r", F.row_number().over(last)).where(F.col("r") == top)
        # A row for each item of the block at most.
        beat = {r["item"]: r["score"] for r in beat.select("item", "score").collect()}
        rest = search_buckets(by_length.where(~ahead), queries, beat, top, whole)
        both = lead.unionAll(rest)
        named = F.element_at(F.lit([None if n is None else str(n) for n in names]), F.col("item") + 1)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        result = (
            both.withColumn("doc_id", F.col("doc_id").cast(kind))
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= top)
            .select(named.cast(item_kind).alias("item_id"), "rank", "doc_id", "score")
        )
        found.append(stored(result, "ranked"))
    if not found:
        return spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, doc_id {kind.simpleString()}, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


@query(
    "op11_lexical_search",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents),
    docs AS (SELECT row_number() OVER () AS row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
    totals AS (SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L FROM docs),
    tf AS (
      SELECT row, doc_id, n, term, count(*) AS tf
      FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
    item_terms AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
    weights AS (
      SELECT term, CAST(floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, totals GROUP BY term, N_),
    impacts AS (
      SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * N_) // L)) AS impact FROM tf, totals),
    scores AS (
      SELECT item_id, row, doc_id, CAST(sum(w * impact) AS BIGINT) AS score
      FROM item_terms JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0 QUALIFY rank <= 50
    """,
)
def op11_lexical_search(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
