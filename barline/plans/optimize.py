"""Portfolio weights from price history."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators import convex, grid, indicators, risk
from barline.session import written
from barline.sources import tables


def dense_returns(bars: DataFrame, filled: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """Daily returns on the gap-filled close grid. ``seen`` has the bars' dates and is cheaper to read, as their ticks are."""
    days = None if seen is None else grid.calendar(seen)
    dense = grid.densify(bars.select("symbol", "date", "close"), fields=["close"], days=days, filled=filled)
    return indicators.simple_return(dense, order="rn").where(F.col("ret").isNotNull())


#: Days of history when no start is given.
HISTORY = 5 * 365


def optimize(
    bars: DataFrame,
    tickers,
    method: str,
    start: date | None = None,
    end: date | None = None,
    risk_free: float = 0.0,
    as_of: date | None = None,
    tolerance: float = 1e-6,
    seen: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(weights, figures) for method ef, cla, cvar or hrp.

    ef and cla: the highest Sharpe ratio; cvar: the least penalised CVaR, reported as the volatility with a
    Sharpe ratio of 0. Both are searched until the duality gap, a column of the figures, is at most
    ``tolerance`` (see ``operators.convex``). hrp gives the inverse-variance allocation, an approximation, with
    figures from the arithmetic mean return. Only ef and cvar drop tiny weights and round the others. Without
    a start the last five years before ``as_of`` (today) count. ``seen`` (the bars' ticks, say) has the bars' symbols and
    dates: the calendar is read from it.
    """
    if method not in ("ef", "cla", "cvar", "hrp"):
        raise ValueError(f"unknown method: {method}")
    if start is None:
        start = (as_of or date.today()) - timedelta(days=HISTORY)
    seen = None if seen is None else tables.filter_bars(seen, tickers, start, end)
    dense = dense_returns(tables.filter_bars(bars, tickers, start, end), seen=seen)
    if method == "hrp":
        returns = convex.written_returns(dense)
        weights = written(risk.inverse_variance(returns).select("symbol", "weight"), "weights")
        return weights, risk.portfolio_stats(returns, weights, risk_free, compounded=False)
    packed = convex.packed_returns(dense)
    returns = convex.unpacked(packed)
    if method == "cvar":
        found = convex.min_cvar(packed, tolerance=tolerance)
    else:
        found = convex.max_sharpe(packed, risk_free, tolerance)
    weights = found.table(returns)
    stats = risk.portfolio_stats(returns, weights, risk_free)
    if method == "cvar":
        cvar = risk.tail_risk(written(risk.portfolio_returns(returns, weights), "portfolio-days")).select("cvar").scalar()
        stats = stats.withColumns({"volatility": cvar, "sharpe_ratio": F.lit(0.0)})
    stats = stats.withColumns({"gap": F.lit(found.gap), "steps": F.lit(found.steps)})
    return weights if method == "cla" else risk.clean_weights(weights), stats


def search(
    bars: DataFrame,
    tickers,
    method: str,
    start: date | None = None,
    end: date | None = None,
    risk_free: float = 0.0,
    count: int = 64,
    seed: int = 7,
    draw=None,
    seen: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(weights, figures) of the best of ``count`` random weight vectors for method ef, cla or cvar: a quick
    look without a bound on what it misses. ``optimize`` finds the best weights."""
    seen = None if seen is None else tables.filter_bars(seen, tickers, start, end)
    returns = convex.written_returns(dense_returns(tables.filter_bars(bars, tickers, start, end), seen=seen))
    scored = risk.score_candidates(returns, count, seed, risk_free=risk_free, draw=draw)
    best = risk.best_candidate(scored, method)
    weights = risk.candidate_weights(returns, best, count, seed, draw=draw)
    if method == "cla":
        return weights, best.drop("candidate")
    return risk.clean_weights(weights), best.drop("candidate")
