"""Global row numbers without a global window, and pages far down an ordered table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.session import written

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place below.
PLACE_BITS = 33


@dataclass
class Numbered:
    """Rows range-sorted into parts, with ``_id`` = part and place in it, and the rows before each part.
    ``begins`` has one row per part, so its size follows the number of partitions, not the rows."""

    rows: DataFrame
    begins: DataFrame

    def numbers(self, out: str = "number") -> DataFrame:
        """All rows with their 0-based number in the order."""
        part = F.shiftright("_id", PLACE_BITS).alias("_part")
        place = F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
        return (
            self.rows.select("*", part)
            .join(F.broadcast(self.begins.select("_part", "_begin")), "_part")
            .withColumn(out, F.col("_begin") + place)
            .drop("_part", "_begin", "_id")
        )

    def page(self, number: int, size: int = 25) -> DataFrame:
        """Page ``number`` (from 0), unordered. Its rows' places are known beforehand, so the scan gets a
        range of ``_id`` and reads only the files that hold it."""
        first, last = number * size, (number + 1) * size
        hit = (F.col("_begin") < last) & (F.col("_begin") + F.col("_n") > first)
        inside = F.lit(False)
        for r in self.begins.where(hit).collect():  # at most ``size`` parts hold a page
            low = (r["_part"] << PLACE_BITS) + max(first - r["_begin"], 0)
            high = (r["_part"] << PLACE_BITS) + min(last - r["_begin"], r["_n"]) - 1
            inside = inside | F.col("_id").between(low, high)
        return self.rows.where(inside).drop("_id")


def numbered(df: DataFrame, order: Sequence[Column]) -> Numbered:
    """Number the rows by a range sort and a count per part. Rows that tie in ``order`` fall into one part,
    so give it a unique last column. The sorted rows are written once: range bounds are sampled, and a
    part that were computed again might get other rows."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ordered.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    counts = rows.groupBy(F.shiftright("_id", PLACE_BITS).alias("_part")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    return Numbered(rows, counts.select("_part", "_n", (upto - F.col("_n")).alias("_begin")))


def next_page(
    df: DataFrame, keys: Sequence[tuple[str, bool]], after: Sequence[Any] | None, size: int = 25
) -> DataFrame:
    """The page that follows the row whose keys are ``after`` (None: the first page). ``keys`` are
    (column, descending) pairs without nulls, together unique. The bound on the first key reaches the scan,
    and what is left is a take-ordered of one page: the cost does not depend on how deep the page lies."""
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in keys]
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (c, down), value in zip(keys, after):
            beyond = beyond | (equal & (F.col(c) < F.lit(value) if down else F.col(c) > F.lit(value)))
            equal = equal & (F.col(c) == F.lit(value))
        (first, down), value = keys[0], after[0]
        df = df.where(F.col(first) <= F.lit(value) if down else F.col(first) >= F.lit(value)).where(beyond)
    return df.orderBy(*order).limit(size)
