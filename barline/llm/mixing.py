"""Mixing sources to target weights.

The documents of a source, laid end to end, are cut into blocks of ``BLOCK`` words. The mix is a
fixed number of output shards; each draws how many of its slots go to which source from a multinomial
over what the sources still have to give, so the draws add up to the targets. The slots of a source are
numbered, and slot number i takes block perm(i mod blocks): a pseudorandom permutation per source and
round (a four-round Feistel network walked until it falls inside), computed on the row. Slots and
blocks meet by (source, block).

Sources are rows of a table, any number of them. Targets come from a few aggregates over it. A multinomial
draw over sources is one over groups of sources followed by one within each group: the first is made
for the at most ``GROUPS`` group sums, the second in a task per group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import NOT_SPACE, query, shuffle_partitions, stored, table
from barline.operators.pages import numbered

BLOCK = 64
SHARDS = 64
SEED = 11
#: How often a source's words may be taken at most.
MAX_REPEAT = 3
#: Running positions are summed in so many parts of each source, so that none is one task's work.
PARTS = 1024
#: Sources fall into so many groups at most, whose sums are drawn first.
GROUPS = 1024
#: A source's entry is copied so often where rows look it up, so that a source's rows are no one task's work.
SALTS = 16


def share_out(sources: DataFrame, most: float = MAX_REPEAT) -> DataFrame:
    """Add ``target`` to rows of source_size and weight: shares in proportion to the weights that add up to
    the sum of sizes. None exceeds ``most`` times its size; what is over goes to the others by weight until
    none is above.

    A source is closed once ``level * weight`` exceeds its limit. Closing raises the level for the others,
    so one number tells which are closed, and each turn is an aggregate over the sources.
    """
    limit, weight = F.col("source_size") * F.lit(most), F.col("weight")
    level = 0.0
    while True:
        above = weight * F.lit(level) > limit
        got = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, limit)).alias("closed"),
            F.sum(F.when(~above, weight)).alias("open"),
        ).first()
        rest = float((got["all"] or 0) - (got["closed"] or 0))
        new = rest / got["open"] if got["open"] else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    share = weight * F.lit(rest) / F.lit(got["open"] or 1.0)
    return sources.withColumn("target", F.when(above, limit).otherwise(F.least(share, limit)).cast("double"))


def shard_sizes(slots: int, shards: int) -> list[int]:
    """Equal shares of the slots, to one."""
    return [slots * (k + 1) // shards - slots * k // shards for k in range(shards)]


def draw_shards(slots: list[int], wanted: list[int], seed) -> np.ndarray:
    """Slots by (shard, source), ``wanted`` of them a shard, which use up all slots. Each shard's counts are
    a multinomial draw over what is left, cut to it; the cut slots are drawn again."""
    left = np.array(slots, dtype=np.int64)
    out = np.zeros((len(wanted), len(left)), dtype=np.int64)
    rng = np.random.default_rng(seed)
    for k, want in enumerate(wanted):
        while want > 0 and left.sum() > 0:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += got
            left -= got
            want -= int(got.sum())
    return out


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 chosen by ``key``: a Feistel network over the smallest even
    number of bits, applied again to what falls outside."""
    i, key = i.astype(np.uint64), key.astype(np.uint64)
    n = n.astype(np.uint64)
    half = (np.ceil(np.log2(np.maximum(n.astype(np.float64), 2.0)) / 2) + 1e-9).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.zeros_like(i)
    todo = np.arange(len(i))
    while len(todo):
        left, right = i[todo] >> half[todo], i[todo] & mask[todo]
        for turn in range(4):
            x = right * np.uint64(0x9E3779B97F4A7C15) + key[todo] + np.uint64(turn)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(32)
            left, right = right, left ^ (x & mask[todo])
        i[todo] = (left << half[todo]) | right
        inside = i[todo] < n[todo]
        out[todo[inside]] = i[todo[inside]]
        todo = todo[~inside]
    return out.astype(np.int64)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(NOT_SPACE)).cast("long").alias("size"),
    )


def plan_mix(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One stored row per source: source, rank by code point (from 0, null last), source_size, weight
    and target. ``weights`` repeat along the ranks."""
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(found, [F.col("source").asc_nulls_last()]).numbers("rank")
    turn = F.pmod("rank", F.lit(len(weights))).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    sources = stored(ranked.withColumn("weight", weight), "sources")
    return stored(share_out(sources, max_repeat).select("source", "rank", "source_size", "weight", "target"), "mix-plan")


def with_source(rows: DataFrame, plan: DataFrame, on: str) -> DataFrame:
    """Rows with columns of their source, found by ``on`` (null meets null). Spark broadcasts the plan if
    its stored size allows; else rows are shuffled by source and salt."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    copies = plan.withColumnRenamed(on, "_on").withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", salt)
    same = rows[on].eqNullSafe(copies["_on"]) & (rows["_salt"] == copies["_to"])
    return rows.join(copies, same).drop("_on", "_salt", "_to")


def place(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Each document with its place ``start`` in its source's stream of words. The stream's order is
    by (part, doc_id), where the part is a hash of the identifier."""
    rows = with_source(sized, plan.select("source", "rank"), "source").select(
        "doc_id", "rank", "size", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part")
    )
    rows = stored(rows, "ranked")
    by_rank = Window.partitionBy("rank").orderBy("part")
    before = (
        rows.groupBy("rank", "part")
        .agg(F.sum("size").alias("s"))
        .select("rank", "part", (F.sum("s").over(by_rank) - F.col("s")).alias("before"))
    )
    within = Window.partitionBy("rank", "part").orderBy("doc_id", "size")
    upto = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("upto", upto)
        .join(before, ["rank", "part"])
        .select("doc_id", "rank", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("start"))
    )


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks' content: a row per document and block it lies in, with the words it gives."""
    last = (F.col("start") + F.col("size") - 1).cast("long")
    first_block = F.expr(f"start div {block}")
    return (
        placed.where("size > 0")
        .select("*", F.explode(F.sequence(first_block, F.expr(f"(start + size - 1) div {block}"))).alias("block"))
        .withColumn("from", F.greatest(F.col("block") * block, F.col("start")))
        .withColumn("upto", F.least(F.col("block") * block + (block - 1), last))
        .select(
            "rank", "block", "doc_id", "start",
            (F.col("from") - F.col("start")).alias("first_word"),
            (F.col("upto") - F.col("from") + 1).alias("n"),
        )
    )


RUNS = "shard int, rank long, count long, begin long, blocks long"


def drawn_runs(plan: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Rows of shard, rank, count, begin and blocks: a shard takes ``count`` slots of a source from its
    ``begin``-th on. Shards are equal to one slot."""
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    # By a source's mean block, as its last block may be short; MAX_REPEAT rounds at most.
    wanted = F.bround(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long")
    sources = plan.withColumn("blocks", blocks).select(
        "rank", "blocks", wanted.alias("slots"), F.pmod("rank", F.lit(GROUPS)).cast("int").alias("group")
    )
    sums = {r["group"]: r["n"] for r in sources.groupBy("group").agg(F.sum("slots").alias("n")).collect()}
    groups = sorted(sums)
    of_shard = shard_sizes(sum(sums.values()), shards)
    # At most GROUPS columns.
    of_group = dict(zip(groups, draw_shards([sums[g] for g in groups], of_shard, seed).T))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        group = int(pdf["group"].iloc[0])
        drawn = draw_shards(pdf["slots"].tolist(), of_group[group].tolist(), [seed, group])
        begin = np.cumsum(drawn, axis=0) - drawn
        shard, at = np.nonzero(drawn)
        return pd.DataFrame({"shard": shard.astype(np.int32), "rank": pdf["rank"].to_numpy()[at],
                             "count": drawn[shard, at], "begin": begin[shard, at],
                             "blocks": pdf["blocks"].to_numpy()[at]})

    return sources.groupBy("group").applyInPandas(draw, RUNS)


def slots(spark, plan: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: a row per slot with shard, slot, rank (of the source) and block. No block is taken more
    than MAX_REPEAT times, and every block of a source is taken once before any is taken again."""
    drawn_df = stored(drawn_runs(plan, block, shards, seed), "draws")

    @F.pandas_udf("long")
    def block_of(i: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permute(i.to_numpy(), n.to_numpy(), key.to_numpy()))

    turn = F.expr("i div blocks")
    step = F.lit(1 << 16)
    return (
        drawn_df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("count") - 1), step.cast("long"))).alias("at"))
        # The count of tasks is given, since these few rows become the many slots.
        .repartition(shuffle_partitions(spark), "shard", "rank", "at")
        .select("shard", "rank", "begin", "blocks", F.explode(F.sequence("at", F.least(F.col("at") + (step - 1), F.col("count") - 1))).alias("k"))
        .withColumn("i", F.col("begin") + F.col("k"))
        .select(
            "shard", "rank", "i",
            block_of(F.col("i") % F.col("blocks"), F.col("blocks"), F.xxhash64("rank", turn, F.lit(seed))).alias("block"),
        )
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
    shards: int = SHARDS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed documents, mixed pieces, plan). The mixed pieces are the training mix: rows of shard,
    i (number of the slot within its source), rank, block, doc_id, start, first_word and n.

    A null text has no words and is never taken; a null source is a source of its own, last in order.
    Rows that repeat an identifier are documents of their own. An empty table gives an empty mix;
    other columns are not looked at.
    """
    sized = stored(_sized(docs, id_col, text_col, source_col), "sizes")
    plan = plan_mix(sized)
    placed = stored(place(sized, plan), "placed")
    # Sizes before the slots are counted out say nothing about them: no broadcast may follow from these.
    drawn = slots(docs.sparkSession, plan, block, shards, seed).hint("merge")
    mixed = drawn.join(pieces(placed, block), ["rank", "block"])
    return placed, mixed, plan


def taken_words(docs: DataFrame, **kw) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken."""
    placed, mixed, plan = mix(docs, **kw)
    # A document with words has its place in the stream to itself.
    taken = mixed.groupBy("rank", "start").agg(F.sum("n").alias("taken"))
    rows = placed.join(taken, ["rank", "start"], "left").withColumn(
        "taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long")
    )
    return with_source(rows, plan, "rank").select("doc_id", "source", "size", "source_size", "target", "taken")


@query("op8_mixing")
def op8_mixing(spark, sf_dir):
    return taken_words(table(spark, sf_dir, "documents")).drop("source")
