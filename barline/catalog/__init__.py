"""All registered queries. Importing the subject modules fills the registry."""

from barline.catalog import (  # noqa: F401
    backtests,
    indicators,
    portfolios,
    prices,
    reports,
    risk,
    sectors,
    signals,
)
from barline.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
