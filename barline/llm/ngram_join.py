"""Near duplicates: an n-gram Jaccard join by MinHash banding.

A document is the set of its five-word shingles. Equal sets are one node. A node's MinHash values are
cut into bands whose number and length come from the target recall; nodes meet in the buckets of equal
band hashes, and each met pair is verified on the full sets.

A bucket of up to ``SMALL`` nodes gives all its pairs. A larger one is dealt into blocks, and each pair of
blocks is a tile whose sets are compared all with all in one worker. A tile gives numbers of links and the
links of a spanning forest, never the pairs, so rows grow with the members of a group and not with its
pairs. Each pair counts once: in the least of the large buckets it shares, or, sharing none, as a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import query, stored, table, words

WIDTH = 5
SIMILARITY = 0.8
RECALL = 0.9999
MAX_HASHES = 128
SMALL = 8
#: Nodes and shingles in a block of a large bucket, in expectation (a longer set is a block's only long one).
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 18
#: Documents whose shingles are in a worker's memory at a time (or one, if it is longer).
BATCH_WORDS = 400_000


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands, and so the fewest false candidates, that reach the recall at
    the similarity with at most ``most`` hash values."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(1, most + 1):
        n = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
        if n * rows <= most:
            best = (n, rows)
    return best


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(word_hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes; fewer words than a shingle has, but not none, are one."""
    h = word_hashes.astype(np.int64).view(np.uint64)
    if not len(h):
        return h
    k = min(width, len(h))
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = mix64(out + h[i : i + len(out)] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def set_key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a = mix64(s + np.uint64(0xD6E8FEB86659FD93))
    b = mix64(s ^ np.uint64(0xA0761D6478BD642F))
    n = np.uint64(len(s))
    return np.array([a.sum(dtype=np.uint64) + n, b.sum(dtype=np.uint64) ^ n], dtype=np.uint64).tobytes()


def _multipliers(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([17, 0])
    n = bands * rows
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(
        0, 2**63, n, dtype=np.uint64
    )


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(sets x bands) hashes of the bands' MinHash values. No set may be empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    a, b = _multipliers(bands, rows)
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    for j in range(bands * rows):
        # The shingle hashes are mixed already; a random line modulo 2^64 orders them anew.
        low = np.minimum.reduceat(flat * a[j] + b[j], at)
        band = j // rows
        out[:, band] = mix64(out[:, band] + low + np.uint64(band + 1))
    return out.view(np.int64)


def _grouped(rows: Iterator[tuple], size=lambda r: len(r[-1])) -> Iterator[list[tuple]]:
    group, total = [], 0
    for row in rows:
        group.append(row)
        total += size(row)
        if total >= BATCH_WORDS:
            yield group
            group, total = [], 0
    if group:
        yield group


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from batch.itertuples(index=False, name=None)


def text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def row_name(doc_id: Column, mark: Column) -> Column:
    """Names a row by its identifier, which may be missing or repeat, and its text."""
    return F.concat_ws(":", mark.cast("string"), doc_id.cast("string"))


def signatures(docs: DataFrame, bands: int, rows: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (a hash of the text), node (null without words), n (shingles), bands."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(_rows(batches)):
            sets = [shingle_set(np.asarray(r[2]), width) for r in group]
            full = [i for i, s in enumerate(sets) if len(s)]
            hashes = iter(band_hashes([sets[i] for i in full], bands, rows) if full else ())
            yield pd.DataFrame({
                "doc_id": [r[0] for r in group],
                "mark": [r[1] for r in group],
                "node": [set_key(s) if len(s) else None for s in sets],
                "n": [len(s) for s in sets],
                "bands": [next(hashes) if len(s) else None for s in sets],
            })

    hashed = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        text_mark(F.col(text_col)).alias("mark"),
        F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("h"),
    )
    return hashed.mapInPandas(sign, "doc_id string, mark long, node binary, n int, bands array<bigint>")


def node_sets(docs: DataFrame, nodes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """node, s (its shingles) of the nodes named by (name, node): name is that of a row that has the set."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(_rows(batches)):
            found = [shingle_set(np.asarray(h), width) for _, h in group]
            yield pd.DataFrame({
                "node": [n for n, _ in group],
                "key": [set_key(s) for s in found],
                "s": [s.view(np.int64) for s in found],
            })

    named = docs.select(row_name(F.col(id_col), text_mark(F.col(text_col))).alias("name"), F.col(text_col).alias("text"))
    hashed = named.join(nodes, "name").select("node", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    made = hashed.mapInPandas(sets, "node binary, key binary, s array<bigint>")
    # Rows may share a name by a collision of hashes; only the one whose set it is counts.
    return made.where("node = key").dropDuplicates(["node"]).select("node", "s")


def _met(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct pairs of small buckets, rows of large ones: bucket, node, blocks) of nodes with n and bands."""
    rows = nodes.select("node", "n", F.posexplode("bands").alias("band", "hash")).select(
        F.xxhash64("band", "hash").alias("bucket"), "node", "n"
    )
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("mass")).where("size > 1")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_NODES, F.col("mass") / BLOCK_SHINGLES)).cast("int")
    known = stored(rows.join(shared.select("bucket", "size", blocks.alias("blocks")), "bucket").drop("n"), "buckets")
    small = (
        known.where(F.col("size") <= SMALL)
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list("node")).alias("m"))
        .select(F.explode(F.expr(
            "flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as a, y as b))))"
        )).alias("p"))
        .select("p.a", "p.b")
    )
    return small.distinct(), known.where(F.col("size") > SMALL).select("bucket", "node", "blocks")


def _marks(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(flags, none set, of the distinct values; the values' places in them one after the other; and by array)."""
    sizes = np.cumsum([len(v) for v in values])[:-1]
    distinct, flat = np.unique(np.concatenate(values), return_inverse=True)
    return np.zeros(len(distinct), dtype=bool), flat, np.split(flat, sizes)


def tile_links(
    left: list[np.ndarray], right: list[np.ndarray] | None, met_left: list[np.ndarray], met_right: list[np.ndarray], similarity: float
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(number of links of each set, links of a spanning forest as numbers of sets), the right ones numbered
    after the left. Links join left and right, or, if there is no right, the left among each other. Sets
    that have met elsewhere, with a common value in ``met``, make no link."""
    part = Fraction(str(similarity))
    top, bottom = part.numerator, part.numerator + part.denominator
    both, met = left + (right or []), met_left + met_right
    first = len(left) if right is not None else 0
    size = np.array([len(s) for s in both], dtype=np.int64)
    flag, _, places = _marks(both)
    flat, starts = np.concatenate(places[first:]), np.append(0, np.cumsum(size[first:])[:-1])
    met_flag, _, met_places = _marks(met)
    met_flat = np.concatenate(met_places[first:])
    met_owner = np.repeat(np.arange(first, len(both)), [len(m) for m in met[first:]])
    links, forest, label = np.zeros(len(both), dtype=np.int64), [], np.arange(len(both))
    for i in range(len(left)):
        wanted = np.zeros(len(both), dtype=bool)
        wanted[max(first, i + 1) :] = True
        if len(met[i]):
            met_flag[met_places[i]] = True
            wanted[met_owner[met_flag[met_flat]]] = False
            met_flag[met_places[i]] = False
        # The similarity of two sets is at most the ratio of their sizes.
        wanted &= np.minimum(size, size[i]) * (bottom - top) >= np.maximum(size, size[i]) * top
        if not wanted.any():
            continue
        flag[places[i]] = True
        shared = np.add.reduceat(flag[flat], starts, dtype=np.int64)
        flag[places[i]] = False
        near = first + np.nonzero(wanted[first:] & (shared * bottom >= (size[first:] + size[i]) * top))[0]
        links[i] += len(near)
        links[near] += 1
        new, at = np.unique(label[near], return_index=True)
        for x, j in zip(new, near[at]):
            if x != label[i]:
                forest.append((i, int(j)))
                label[label == x] = label[i]
    return links, forest


def tiled(large: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, null, links of a) and (a, b, 0) for links (a, b) that join the same classes as all links do, of
    the pairs of nodes that share a large bucket. Bounded by the rows of ``large`` times their blocks."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows are sorted by tile; a tile's are consecutive.
        for (_, low, high), rows in groupby(_rows(batches), key=lambda r: r[:3]):
            sides: tuple[list, list] = ([], [])
            for _, _, _, block, node, met, s in rows:
                sides[block != low].append((node, np.asarray(met, dtype=np.int64), np.asarray(s)))
            left, right = sides
            if not left or low != high and not right or len(left) + len(right) < 2:
                continue
            links, forest = tile_links(
                [s for _, _, s in left], [s for _, _, s in right] if low != high else None,
                [m for _, m, _ in left], [m for _, m, _ in right], similarity,
            )
            names = [n for n, _, _ in left + right]
            have = np.nonzero(links)[0]
            if len(have):
                ends = [sorted((names[i], names[j])) for i, j in forest]
                yield pd.DataFrame({
                    "a": [names[i] for i in have] + [a for a, _ in ends],
                    "b": [None] * len(have) + [b for _, b in ends],
                    "links": [int(links[i]) for i in have] + [0] * len(ends),
                })

    homes = large.groupBy("node").agg(F.collect_list(F.struct("bucket", "blocks")).alias("homes"))
    block = F.pmod(F.xxhash64("node", F.lit(0)), F.col("home.blocks")).cast("int")
    dealt = (
        sets.join(homes, "node")
        .select("node", "s", "homes", F.explode("homes").alias("home"))
        .select(
            "node", "s", F.col("home.bucket").alias("bucket"), block.alias("block"),
            F.expr("transform(filter(homes, h -> h.bucket < home.bucket), h -> h.bucket)").alias("met"),
            F.explode(F.sequence(F.lit(0), F.col("home.blocks") - 1)).alias("other"),
        )
        .select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "met", "s")
        .repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
    )
    return dealt.mapInPandas(compare, "a binary, b binary, links long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least the similarity, compared in whole numbers."""
    part = Fraction(str(similarity))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    total = (F.size("sa") + F.size("sb")).cast("long")
    enough = shared * (part.numerator + part.denominator) >= total * part.numerator
    return both.where(enough).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each class, by labels that travel along the links and are
    looked up at each other until none changes."""
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b"), F.col("a"))), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(seen, labels["node"] == seen["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        up = nearer.select(F.col("node").alias("up"), F.col("label").alias("above"))
        moved = stored(
            nearer.join(up, nearer["label"] == up["up"]).select("node", "old", F.least("label", "above").alias("label")),
            "labels",
        )
        if moved.where("label != old").limit(1).count() == 0:
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def classes(docs: DataFrame, similarity: float, recall: float, width: int, id_col: str, text_col: str) -> DataFrame:
    """What ``near_groups`` returns, with mark (a hash of the text) and label (of the class, null without words)."""
    kind = docs.schema[id_col].dataType
    bands, rows = bands_for(similarity, recall)
    signed = stored(signatures(docs, bands, rows, width, id_col, text_col), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.min(row_name(F.col("doc_id"), F.col("mark"))).alias("name"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    pairs, large = _met(nodes)
    pairs = stored(pairs, "pairs")
    met = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).unionAll(large.select("node")).distinct()
    wanted = nodes.join(met, "node", "left_semi").select("name", "node")
    sets = stored(node_sets(docs, wanted, width, id_col, text_col), "sets")
    inside = stored(tiled(large, sets, similarity), "tiles")
    # What shares a large bucket is counted there.
    homes = large.groupBy("node").agg(F.collect_list("bucket").alias("homes"))
    for c in "ab":
        pairs = pairs.join(homes.select(F.col("node").alias(c), F.col("homes").alias(f"h{c}")), c, "left")
    apart = pairs.where(~F.coalesce(F.arrays_overlap("ha", "hb"), F.lit(False))).select("a", "b")
    links = stored(verified(apart, sets, similarity), "links")
    labels = components(links.unionAll(inside.where("b is not null").select("a", "b").distinct()))
    one = F.lit(1).cast("long").alias("links")
    ends = links.select(F.col("a").alias("node"), one).unionAll(links.select("b", one))
    degree = ends.unionAll(inside.where("b is null").select("a", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    named = signed.groupBy("node").agg(F.min(F.col("doc_id").cast(kind)).alias("least"), F.count("*").alias("rows"))
    member = named.where("node is not null").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = member.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"))
    facts = member.select("node", "label").join(sizes, "label").join(degree, "node", "left").select(
        "node", "label", "class_id", "class_size", "links"
    )
    return signed.select(F.col("doc_id").cast(kind).alias("doc_id"), "mark", "node").join(facts, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        "node", "mark", "label",
    )


def near_groups(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest identifier of the class),
    class_size (rows), links (verified links of the document's set to other sets), node.

    Words are lower-case; a text of fewer than ``width`` words, but not none, is one shingle. Texts
    without words and null texts are similar to nothing: each is a class of its own. Documents with
    equal sets are one class without links among them. Links are all of those that the recall finds,
    in groups of any size. A row is a document of its own, whether its identifier is missing or repeats; rows
    without one take part as texts, and their class is named by the others; class_id is null if there are none.
    An empty table gives an empty result; other columns are not looked at.
    """
    return classes(docs, similarity, recall, width, id_col, text_col).drop("mark", "label")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, but one row of each class of near duplicates.

    The row with the smallest identifier stays, a missing one only if the class has no other; of rows that
    repeat it, the one with the least hash of its text, and of rows that repeat both, any one. Texts without words
    and null texts stay, and so does an unlike text whose identifier another row repeats. An empty table
    stays empty.
    """
    rows = stored(classes(docs, SIMILARITY, RECALL, WIDTH, id_col, text_col).where("label is not null"), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark")
    best = rows.groupBy("label").agg(F.min(rank).alias("best"))
    judged = rows.select("label", rank.alias("rank")).join(best, "label")
    gone = judged.where("rank != best").select("rank.doc_id", "rank.mark").distinct()
    mark = text_mark(docs[text_col])
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["doc_id"]) & (mark == gone["mark"]), "left_anti")
    again = judged.where("rank = best").groupBy("rank").count().where("count > 1").select("rank.doc_id", "rank.mark")
    again = stored(again, "repeated")
    if again.limit(1).count() == 0:
        return out
    same = docs[id_col].eqNullSafe(again["doc_id"]) & (mark == again["mark"])
    return out.join(again, same, "left_anti").unionAll(
        out.join(again, same, "left_semi").dropDuplicates([id_col, text_col])
    )


@query("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents")).drop("node")
