"""From raw documents to a training mix.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns documents
with their columns, the last one the mix. Rows with nulls, repeated rows and empty tables go through
every stage as its operator's docstring says; further columns of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barline.llm.common import stored, table
from barline.llm.decontamination import drop_contaminated
from barline.llm.exact_dedup import drop_copies
from barline.llm.mixing import taken_words
from barline.llm.ngram_join import keep_one
from barline.llm.quality import drop_rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return taken_words(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("ngram jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
]

#: Learned scores, MinHash and pseudorandom permutations have no SQL twin; tests compare the pipeline
#: with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
