"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is ``window`` consecutive words of an item (a shorter item is one window), taken as the set
of its word shingles. A document passage of the same length contains it only if it has every shingle,
so the necessary prefix in rarity order is one shingle: the window's rarest over all documents. The
documents' shingles meet those prefixes by hash; the shingle's place in the window gives the passage
(positional bound), which must lie inside the document (length bound) and is compared word by word.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import query, stored, table, words

WINDOW = 13
SHINGLE = 5
#: Windows and item identifiers that one broadcast may hold (some 100 bytes each). A larger benchmark
#: is joined in as many blocks as it needs.
BLOCK = 200_000


def _hash(array: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(array, at + F.lit(i)) for i in range(width)])


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per distinct window: window (its words), len, width (of its shingles), items."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(
        F.size("w") > 0
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return (
        w.select("item", "w", F.explode(starts).alias("s"))
        .select("item", F.slice("w", F.col("s"), window).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("len", F.size("window"))
        .withColumn("width", F.least(F.lit(SHINGLE), F.col("len")))
    )


def _window_shingles(windows: DataFrame, width: int) -> DataFrame:
    return (
        windows.where(F.col("width") == width)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("len") - width)).alias("offset"))
        .withColumn("shingle", _hash(F.col("window"), F.col("offset"), width))
    )


def _positions(docs: DataFrame, width: int) -> DataFrame:
    """A row per word of a document, with the shingle that begins there, and one row at its end with
    the shingle 0, by which documents without any match stay in the result."""
    return (
        docs.select("*", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
        .withColumn("n", F.size("w"))
        .withColumn(
            "shingle",
            F.when(F.col("pos") + width <= F.col("n"), _hash(F.col("w"), F.col("pos"), width)).when(
                F.col("pos") == F.col("n"), F.lit(0).cast("long")
            ),
        )
    )


def _blocks(df: DataFrame, total: int, key: str) -> list[DataFrame]:
    n = max(1, math.ceil(total / BLOCK))
    if n == 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n)) == i) for i in range(n)]


def _rarity(docs: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """How often each shingle of the windows occurs in the documents."""
    wanted = _window_shingles(windows, width).select("shingle").distinct()
    at = _positions(docs, width).select("shingle")
    found = [
        at.join(F.broadcast(part), "shingle")
        for part in _blocks(wanted, wanted.count(), "shingle")
    ]
    return reduce(DataFrame.unionAll, found).groupBy("shingle").agg(F.count("*").alias("freq"))


def _prefixes(docs: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Each window with its rarest shingle and that shingle's place in it."""
    ranked = (
        _window_shingles(windows, width)
        .join(_rarity(docs, windows, width), "shingle", "left")
        .select(
            "window", "items", "len",
            F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "shingle", "offset").alias("rank"),
        )
    )
    return (
        ranked.groupBy("window", "items", "len")
        .agg(F.min("rank").alias("rank"))
        .select("window", "items", "len", "rank.shingle", "rank.offset")
    )


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (array of word positions start, end of the
    occurring windows, end exclusive, sorted) and items (sorted item identifiers as text).

    Null and empty texts have no words and no hits; items without words are no windows; items with
    equal text all count; an item without an identifier hits words but is not listed. Rows that repeat both identifier and text give as many equal rows. An empty
    benchmark hits nothing. Other columns of either table are not looked at.
    """
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        words(F.col(text_col)).alias("w"),
    )
    windows = stored(benchmark_windows(items, item_col, item_text_col, window), "windows")
    sizes = windows.groupBy("width").agg(F.sum(F.size("items") + 1).alias("n")).collect()
    end = docs.sparkSession.range(1).select(
        F.array().cast("array<string>").alias("window"),
        F.array().cast("array<string>").alias("items"),
        F.lit(0).alias("len"),
        F.lit(0).cast("long").alias("shingle"),
        F.lit(0).alias("offset"),
    )
    passes = []
    for row in sizes:
        prefixes = stored(_prefixes(own, windows, row["width"]), "prefixes")
        passes += [(row["width"], part) for part in _blocks(prefixes, row["n"], "window")]
    if passes:
        passes[0] = (passes[0][0], passes[0][1].unionByName(end))
    else:
        passes = [(1, end)]
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n"))
    same = F.when(F.col("len") == 0, F.col("pos") == F.col("n")).when(
        inside, F.slice("w", F.when(inside, start + 1).otherwise(1), F.col("len")) == F.col("window")
    )
    found = [
        _positions(own, width)
        .join(F.broadcast(part), "shingle")
        .where(same)
        .select("doc_id", "text_key", "n", start.alias("start"), "len", "items")
        for width, part in passes
    ]
    span = F.when(F.col("len") > 0, F.struct("start", (F.col("start") + F.col("len")).alias("end")))
    return (
        reduce(DataFrame.unionAll, found)
        .groupBy("doc_id", "text_key", "n")
        .agg(
            F.array_sort(F.collect_set(span)).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            F.count(F.when(F.col("len") == 0, 1)).alias("rows"),
        )
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
        .select("doc_id", "text_key", F.col("n").cast("long").alias("n_words"), "spans", "items")
    )


def contamination(hits: DataFrame) -> DataFrame:
    """The figures of ``benchmark_hits``: words inside any span count once; a document is
    contaminated if at least a twentieth of its words are hit."""
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["end"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return hits.withColumn("n_hit", covered).select(
        "doc_id",
        "text_key",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    bad = (
        contamination(benchmark_hits(docs, items))
        .where("contaminated")
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
        .distinct()
    )
    same = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__key"])
    return docs.join(bad, same, "left_anti")


_SQL = r"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
    SELECT item_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), iw AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g
    FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM b WHERE len(w) > 0)
), dw AS (
    SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS g
    FROM (SELECT d.*, k, unnest(generate_series(1, len(w) - k + 1)) AS s
          FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)
), m AS (
    SELECT doc_id, s, dw.k, item_id FROM dw JOIN iw USING (k, g)
), h AS (
    SELECT doc_id, count(*) AS n_hit FROM (
        SELECT DISTINCT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM m) GROUP BY doc_id
), i AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (
        SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@query("op2_benchmark_decontamination", _SQL)
def op2_benchmark_decontamination(spark, sf_dir):
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contamination(hits).drop("text_key")
