"""Named queries over the given tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# Shown numbers are scaled, floored and scaled back. Quotients of whole cents often end exactly on
# a rounding tie, where the last bit of a differently ordered sum would decide; the odd offset puts
# the cut where such quotients do not fall. Whole numbers stay whole.
OFFSET = 0.3717


def r(c: Column | str, digits: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(OFFSET)).cast("double") / scale


def rsql(expr: str, digits: int = 4) -> str:
    """SQL twin of ``r``; the added zero turns -0.0 into 0.0."""
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expr}) * {scale} + {OFFSET}::DOUBLE) / {scale} + 0.0::DOUBLE)"


def tidy(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    """Select columns; doubles are rounded and decimals become rounded doubles."""
    out = []
    for c in cols or df.columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.DoubleType, T.DecimalType)):
            out.append(r(F.col(c).cast("double"), digits).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
