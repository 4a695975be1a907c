"""Latest price per symbol kept current from a stream of bars.

The batch library answers "latest close" by scanning a date range; clients used to poll for it.
Over a stream the same aggregate keeps one row of state per symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_prices(stream: DataFrame) -> DataFrame:
    """Update-mode aggregate; a late, older bar changes nothing."""
    return stream.groupBy("symbol").agg(
        F.max_by("close", "date").alias("price"), F.max("date").alias("price_date")
    )
