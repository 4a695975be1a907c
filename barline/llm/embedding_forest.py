"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors are one node. Each tree splits its nodes again and again by the median of a random projection;
nodes close to a median go to both sides, so that close pairs seldom part, and many trees make it rarer still.
The splits of a group are fitted on a sample of its nodes, several levels at a time, by one task for each
group; groups that are still large are split in the next round. A group that a split cannot part, because most
of its nodes lie within the margin, stays whole.

Nodes that share a leaf are compared, a large leaf in tiles of two blocks. A pair counts in the least leaf
that it shares. A tile gives numbers of links and, for each class it finds, the edges of a tree of small degree,
never its pairs. Classes are united over all tiles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.common import query, stored, table
from barline.llm.ngram_join import components

COSINE = 0.95
TREES = 6
#: Half the width of the zone around a median whose nodes go to both sides, in typical projected distances
#: of two nodes at the threshold.
SPILL = 0.5
#: Nodes that a leaf should have at most.
LEAF = 1024
#: Levels that a round splits, and the nodes of a group that its splits are fitted on.
LEVELS, SAMPLE = 5, 2048
#: A split that sends more than this part of a group to both sides is given up, after some other directions.
STUCK, DIRECTIONS = 0.6, 4
#: Nodes in a block of a large leaf.
BLOCK = 4096
#: Leaves that are looked at together when links are told from those of other leaves.
COLUMNS = 2048
MASK = (1 << 64) - 1


def mixed(*parts: int) -> int:
    """A number in 0..2^63-1 that depends on all parts."""
    h = 0
    for p in parts:
        h = (h ^ (p & MASK)) * 0x9E3779B97F4A7C15 & MASK
        h ^= h >> 29
        h = h * 0xBF58476D1CE4E5B9 & MASK
        h ^= h >> 32
    return h >> 1


def nodes_of(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, type]:
    """(vec_id, node (null for a vector that links with nothing), dim, raw (its components); their type)"""
    double = isinstance(rows.schema[vec_col].dataType.elementType, T.DoubleType)
    kind = np.float64 if double else np.float32

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, dims, raws = [], [], []
            for v in batch["v"]:
                x = None if v is None else np.array([np.nan if e is None else e for e in v], dtype=kind) + kind(0)
                node = raw = None
                if x is not None and len(x) and np.isfinite(x).all() and x.any():
                    raw = x.tobytes()
                    node = hashlib.blake2b(raw, digest_size=16).digest()
                nodes.append(node)
                dims.append(0 if raw is None else len(x))
                raws.append(raw)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "node": nodes, "dim": dims, "raw": raws})

    narrow = rows.select(F.col(id_col).cast("string").alias("vec_id"), F.col(vec_col).alias("v"))
    return narrow.mapInPandas(read, "vec_id string, node binary, dim int, raw binary"), kind


def unit(raws: list[bytes], kind) -> np.ndarray:
    """The vectors over their lengths, in double precision. Scaled first, so that no square over- or underflows."""
    x = np.stack([np.frombuffer(r, dtype=kind) for r in raws]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def direction(leaf: int, place: int, turn: int, dim: int) -> np.ndarray:
    """The random direction of a split: the same wherever it is asked for."""
    u = np.random.default_rng([leaf, place, turn]).standard_normal(dim)
    return u / np.linalg.norm(u)


def fit(leaf: int, x: np.ndarray, levels: int, margin: float) -> list[tuple[int, int, float]]:
    """(place, turn, median) of the splits of a group; places are numbered like those of a heap, from 1."""
    splits, todo = [], [(1, np.arange(len(x)), levels)]
    while todo:
        place, mine, left = todo.pop()
        if not left or len(mine) < 16:
            continue
        for turn in range(DIRECTIONS):
            p = x[mine] @ direction(leaf, place, turn, x.shape[1])
            median = float(np.median(p))
            if (np.abs(p - median) <= margin).mean() <= STUCK:
                splits.append((place, turn, median))
                todo.append((2 * place, mine[p <= median + margin], left - 1))
                todo.append((2 * place + 1, mine[p >= median - margin], left - 1))
                break
    return splits


def route(leaf: int, x: np.ndarray, splits: dict[int, tuple[int, float]], margin: float) -> Iterator[tuple[int, np.ndarray]]:
    """(new leaf, places of its nodes)"""
    todo = [(1, np.arange(len(x)))]
    while todo:
        place, mine = todo.pop()
        if not len(mine):
            continue
        if place not in splits:
            yield mixed(leaf, place), mine
            continue
        turn, median = splits[place]
        p = x[mine] @ direction(leaf, place, turn, x.shape[1])
        todo.append((2 * place, mine[p <= median + margin]))
        todo.append((2 * place + 1, mine[p >= median - margin]))


def forest(nodes: DataFrame, kind, cosine: float, trees: int, spill: float, leaf_size: int) -> DataFrame:
    """(node, leaf) of all trees. ``nodes``: node, dim, raw."""
    gap = math.sqrt(2 - 2 * cosine)

    def margin(dim: int) -> float:
        return spill * gap / math.sqrt(dim)

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in range(trees):
                yield pd.DataFrame({**batch, "leaf": [mixed(t, d) for d in batch["dim"]]})

    def fit_group(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        dim, levels = int(group["dim"].iloc[0]), int(group["levels"].iloc[0])
        group = group.sort_values("node", key=lambda c: c.map(bytes.hex))
        found = fit(key[0], unit(group["raw"], kind), levels, margin(dim))
        return pd.DataFrame({
            "leaf": [key[0]], "places": [[s[0] for s in found]], "turns": [[s[1] for s in found]], "medians": [[s[2] for s in found]]
        })

    def route_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for leaf, group in batch.groupby("leaf", sort=False):
                first = group.iloc[0]
                splits = dict(zip(first["places"], zip(first["turns"], first["medians"])))
                raws = group["raw"].to_numpy()
                for new, mine in route(int(leaf), unit(raws, kind), splits, margin(int(first["dim"]))):
                    done = pd.DataFrame({c: group[c].to_numpy()[mine] for c in ("node", "dim", "raw")})
                    yield done.assign(leaf=new)

    schema = "node binary, dim int, raw binary, leaf long"
    rows = stored(nodes.select("node", "dim", "raw").mapInPandas(plant, schema), "forest")
    finished: list[DataFrame] = []
    while True:
        sizes = rows.groupBy("leaf").agg(F.count("*").alias("size"))
        large = stored(sizes.where(F.col("size") > leaf_size), "large-leaves")
        if large.limit(1).count() == 0:
            finished.append(rows.select("node", "leaf"))
            break
        levels = F.least(F.lit(LEVELS), F.ceil(F.log2(F.col("size") / leaf_size)).cast("int"))
        chance = F.pmod(F.xxhash64("node", "leaf"), F.lit(1 << 30)) < F.lit(float(SAMPLE) * (1 << 30)) / F.col("size")
        sample = rows.join(large, "leaf").where(chance).select("leaf", "node", "dim", "raw", levels.alias("levels"))
        splits = stored(
            sample.groupBy("leaf").applyInPandas(fit_group, "leaf long, places array<int>, turns array<int>, medians array<double>"),
            "splits",
        )
        useful = splits.where(F.size("places") > 0)
        finished.append(rows.join(useful, "leaf", "left_anti").select("node", "leaf"))
        rows = stored(rows.join(useful, "leaf").mapInPandas(route_rows, schema), "forest")
    out = finished[0]
    for more in finished[1:]:
        out = out.unionAll(more)
    return out


def shared_less(met: list[np.ndarray], links: np.ndarray) -> np.ndarray:
    """Of the links (pairs of places), those whose nodes have no value of ``met`` in common."""
    ends = np.unique(links)
    at = np.zeros(len(met), dtype=np.int64)
    at[ends] = np.arange(len(ends))
    owner = np.repeat(np.arange(len(ends)), [len(met[e]) for e in ends])
    if not len(owner):
        return links
    _, value, count = np.unique(np.concatenate([met[e] for e in ends]), return_inverse=True, return_counts=True)
    often = count[value] > 1
    used, value = np.unique(value[often], return_inverse=True)
    if not len(used):
        return links
    keep = np.ones(len(links), dtype=bool)
    owner = owner[often]
    for low in range(0, len(used), COLUMNS):
        has = np.zeros((len(ends), min(COLUMNS, len(used) - low)), dtype=bool)
        mine = (value >= low) & (value < low + COLUMNS)
        has[owner[mine], value[mine] - low] = True
        for i in range(0, len(links), 4096):
            a, b = at[links[i : i + 4096, 0]], at[links[i : i + 4096, 1]]
            keep[i : i + 4096] &= ~(has[a] & has[b]).any(axis=1)
    return links[keep]


def tile(x: np.ndarray, weight: np.ndarray, met: list[np.ndarray], first: int, cosine: float):
    """(weight of the nodes linked to each node, class of each node) of the pairs among ``x``, or, if ``first``,
    of those before ``first`` with those from there on."""
    n = len(x)
    linked, label = np.zeros(n, dtype=np.int64), np.arange(n)
    rows = range(0, first or n, 512)
    for i in rows:
        end = min(i + 512, first or n)
        start = first or i
        near = x[i:end] @ x[start:].T >= cosine
        if not first:
            near &= np.arange(start, n)[None, :] > np.arange(i, end)[:, None]
        if not near.any():
            continue
        a, b = np.nonzero(near)
        links = shared_less(met, np.stack([a + i, b + start], axis=1))
        np.add.at(linked, links[:, 0], weight[links[:, 1]])
        np.add.at(linked, links[:, 1], weight[links[:, 0]])
        cuts = np.searchsorted(links[:, 0], np.arange(i, end + 1))
        for j in np.unique(links[:, 0]):
            mine = links[cuts[j - i] : cuts[j - i + 1], 1]
            joined = np.unique(label[np.append(mine, j)])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return linked, label


def compared(dealt: DataFrame, kind, cosine: float) -> DataFrame:
    """(a, null, weight linked to a) and (a, b, 0): edges that join the same classes as the links do."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        for (_, low, high, _), rows in groupby(stream, key=lambda r: r[:4]):
            rows = sorted(rows, key=lambda r: r[4] != low)
            first = sum(r[4] == low for r in rows) if low != high else 0
            if len(rows) < 2 or low != high and first in (0, len(rows)):
                continue
            met = [np.asarray(r[8], dtype=np.int64) for r in rows]
            common = set(met[0].tolist()).intersection(*(m.tolist() for m in met[1:]))
            if common:  # all of them are compared there
                continue
            linked, label = tile(unit([r[6] for r in rows], kind), np.array([r[7] for r in rows]), met, first, cosine)
            have = np.nonzero(linked)[0]
            if not len(have):
                continue
            names = [r[5] for r in rows]
            classes: dict[int, list[int]] = {}
            for i in have:
                classes.setdefault(int(label[i]), []).append(i)
            edges = [(mine[(k - 1) // 2], mine[k]) for mine in classes.values() for k in range(1, len(mine))]
            yield pd.DataFrame({
                "a": [names[i] for i in have] + [names[i] for i, _ in edges],
                "b": [None] * len(have) + [names[j] for _, j in edges],
                "linked": [int(linked[i]) for i in have] + [0] * len(edges),
            })

    return dealt.mapInPandas(compare, "a binary, b binary, linked long")


def near_vectors(
    rows: DataFrame,
    cosine: float = COSINE,
    trees: int = TREES,
    spill: float = SPILL,
    leaf_size: int = LEAF,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept.

    Vectors link when the cosine of their angle, in double precision, is ``cosine`` or more; equal vectors do.
    n_links counts the other rows linked directly, component_id is the smallest identifier reachable. Vectors
    that are null, empty, zero or hold a null or non-finite component link with nothing, and vectors of
    different lengths do not link with each other. A row that repeats an identifier is a vector of its own. A
    missing identifier names no component; kept is true where vec_id and component_id are equal or both
    missing. An empty table gives an empty result; other columns are not looked at.

    A pair is found unless all trees part it. In 64 dimensions a split parts a pair at the threshold in about
    2 of 100 cases, so twelve levels of splits in six trees miss 1 pair of 10,000 of those that lie right at it.
    """
    id_kind = rows.schema[id_col].dataType
    read, kind = nodes_of(rows, id_col, vec_col)
    read = stored(read, "vectors")
    nodes = stored(
        read.where("node is not null")
        .groupBy("node")
        .agg(F.count("*").alias("rows"), F.min(F.col("vec_id").cast(id_kind)).alias("least"), F.first("dim").alias("dim"), F.first("raw").alias("raw")),
        "nodes",
    )
    places = stored(forest(nodes, kind, cosine, trees, spill, leaf_size), "places")
    sizes = places.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
    blocks = stored(sizes.select("leaf", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "leaf-sizes")
    # A node's leaves are few: one for each tree and each margin it lies in.
    homes = places.join(blocks, "leaf").groupBy("node").agg(F.collect_list(F.struct("leaf", "blocks")).alias("homes"))
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("home.blocks")).cast("int")
    dealt = (
        nodes.join(homes, "node")
        .select("node", "dim", "raw", "rows", "homes", F.explode("homes").alias("home"))
        .select(
            F.col("home.leaf").alias("leaf"), block.alias("block"), "node", "dim", "raw", "rows",
            F.expr("transform(filter(homes, h -> h.leaf < home.leaf), h -> h.leaf)").alias("met"),
            F.explode(F.sequence(F.lit(0), F.col("home.blocks") - 1)).alias("other"),
        )
        .select(
            "leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "dim", "block",
            "node", "raw", "rows", "met",
        )
        .repartition("leaf", "low", "high")
        .sortWithinPartitions("leaf", "low", "high", "dim")
    )
    found = stored(compared(dealt, kind, cosine), "tiles")
    labels = components(found.where("b is not null").select("a", "b").distinct())
    degree = found.where("b is null").groupBy("a").agg(F.sum("linked").alias("linked")).withColumnRenamed("a", "node")
    member = nodes.select("node", "rows", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = member.groupBy("label").agg(F.min("least").alias("component_id"))
    facts = member.join(named, "label").join(degree, "node", "left").select(
        "node", "component_id", (F.col("rows") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    vec = F.col("vec_id")
    return (
        read.select(vec.cast(id_kind).alias("vec_id"), "node")
        .join(facts, "node", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("node").isNull(), vec).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", vec.eqNullSafe(F.col("component_id")))
    )


@query("op12_embedding_near_dedup")
def op12_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
