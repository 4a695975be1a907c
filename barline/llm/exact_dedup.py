"""Exact duplicates by a tree-merge of sorted digest runs.

Every partition makes a run of (digest, surviving identifier, count) sorted by digest. In each round
the runs are cut by the next digits of the partition that owns a digest, groups of ``FAN_IN``
partitions exchange the pieces, and each merges what it got, keeping one identifier per digest. After
log(partitions) rounds a partition holds the finished run of its own share of the digests. A group of
copies shrinks to one row per partition before anything is exchanged, so its size does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import power_of_two, query, shuffle_partitions, stored, table

#: Bits of the owner's number that one round settles, and so 4 runs per merge.
ROUND_BITS = 2
FAN_IN = 1 << ROUND_BITS
#: What makes two texts equal: SHA-256, verified by the length and an independent hash.
KEY = ["digest", "bytes", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).alias("bytes"),
        F.xxhash64(text).alias("check"),
    )


def _merge(runs: DataFrame, parts: int, largest: bool) -> DataFrame:
    # The struct buffer keeps Spark on a sort aggregate, which merges rows in digest order and spills.
    return (
        runs.repartition(parts, "part")
        .groupBy("part", *KEY)
        .agg((F.max if largest else F.min)("keep").alias("keep"), F.sum("n").alias("n"))
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text equals the empty text. Of equal texts the largest (else the smallest) identifier
    stays; a missing identifier loses against any other, and where all are missing keep_id is null.
    Rows that repeat an identifier with the same text count in group_size, and one of them is kept.
    An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    bits = power_of_two(max(2, shuffle_partitions(spark))).bit_length() - 1
    parts = 1 << bits
    rows = stored(
        digests(docs, id_col, text_col).withColumn(
            "row", F.monotonically_increasing_id()
        ).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")),
        "digests",
    )
    # A missing identifier comes last in either direction; the row's number settles repeated ones.
    last = F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull()
    keep = F.struct(last.alias("last"), "doc_id", "row")
    first = rows.select("part", *KEY, keep.alias("keep"), F.lit(1).cast("long").alias("n"))
    runs = first = _merge(first, parts, largest)
    owner = F.pmod(F.col("check"), F.lit(parts)).cast("int")
    for low in range(0, bits, ROUND_BITS):
        digits = ((1 << min(bits, low + ROUND_BITS)) - 1) & ~((1 << low) - 1)
        to = F.col("part").bitwiseAND(parts - 1 - digits).bitwiseOR(owner.bitwiseAND(digits))
        runs = _merge(runs.withColumn("part", to), parts, largest)
    finished = runs.select(*KEY, "keep", F.col("n").alias("group_size"))
    # A digest has a row per partition at most in the first runs, so a large group is split over all.
    local = first.select("part", *KEY).join(finished, KEY)
    return rows.join(local, ["part", *KEY]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts, null and empty ones alike, the row
    with the largest identifier, a missing one only if there is no other; of rows that repeat both, any one. An empty
    table stays empty.
    """
    groups = stored(exact_groups(docs, id_col, text_col), "exact-groups")
    kept = groups.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"), 256)
    out = docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]) & (sha == kept["__sha"]), "left_semi")
    repeated = groups.where("not kept and doc_id <=> keep_id").limit(1).count()
    if not repeated:
        return out
    key = "sha"
    while key in out.columns:
        key += "_"
    return out.withColumn(key, sha).dropDuplicates([id_col, key]).drop(key)


@query(
    "op7_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op7_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))
