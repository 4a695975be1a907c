"""Return and risk statistics, and scoring of weight vectors.

Portfolio variance is taken from the portfolio's own daily return series: on complete returns
var(Σ w·r) equals w'Σw. That is linear in the data, so no pair of symbols is ever formed for it;
the pair matrices below are for those who want the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.session import written

YEAR = 252.0


def mean_return(
    returns: DataFrame, by: str = "symbol", ret: str = "ret", compounded: bool = True
) -> DataFrame:
    """Compounded annual return (Π(1+r))^(252/n) - 1, or the arithmetic mean times 252."""
    if not compounded:
        return returns.groupBy(by).agg((F.avg(ret) * YEAR).alias("mean_return"))
    total, n = F.sum(F.log1p(ret)), F.count(ret)
    return returns.groupBy(by).agg((F.exp(total * YEAR / n) - 1.0).alias("mean_return"))


def inverse_variance(returns: DataFrame, by: str = "symbol", ret: str = "ret") -> DataFrame:
    """Weights proportional to 1/variance; keys without variance get none."""
    per = returns.groupBy(by).agg(F.var_samp(ret).alias("variance")).where(F.col("variance") > 0)
    total = per.select(F.sum(1.0 / F.col("variance"))).scalar()
    return per.withColumn("weight", 1.0 / F.col("variance") / total)


#: Keys per block of a pair matrix; a task holds two blocks' returns over the calendar.
BLOCK = 64


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Statistics of all pairs between two blocks (or within one) on their common dates."""
    r = pdf.pivot_table(index="day", columns="key", values="ret", aggfunc="first", sort=True)
    seen = r.notna().to_numpy(dtype=float)
    x = r.fillna(0.0).to_numpy()
    n, sx, sxx, sxy = seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x
    keys = r.columns.to_numpy()
    block = pdf.drop_duplicates("key").set_index("key")["block"].reindex(keys).to_numpy()
    within = pdf["first"].iloc[0] == pdf["second"].iloc[0]
    i, j = np.triu_indices(len(keys))
    use = (n[i, j] > 0) & (within | (block[i] != block[j]))
    i, j = i[use], j[use]
    return pd.DataFrame({
        "a": keys[i], "b": keys[j], "n": n[i, j], "sx": sx[i, j], "sy": sx[j, i],
        "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j],
    })


def _pairs(returns: DataFrame, keys, by: str, ret: str, order: str) -> DataFrame:
    """Sums of products over the common dates, for all pairs a <= b of the named keys (a list, or a
    table with the column ``by``). The result has a row per pair, that is what was asked for.

    Keys are dealt into blocks; every pair of blocks is one group, so a task holds the returns of two
    blocks, whatever the number of keys. No self-join.
    """
    spark = returns.sparkSession
    if not isinstance(keys, DataFrame):
        kind = returns.schema[by].dataType
        keys = spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(by, kind)]))
    named = keys.select(by).distinct()
    blocks = F.greatest(F.ceil(named.select(F.count("*")).scalar() / BLOCK), F.lit(1)).cast("int")
    own = returns.join(named, by).select(
        F.col(by).cast("string").alias("key"), F.col(order).alias("day"), F.col(ret).cast("double").alias("ret"),
        F.pmod(F.xxhash64(by), blocks).cast("int").alias("block"), blocks.alias("blocks"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = own.select("key", "day", "ret", "block", other).select(
        "key", "day", "ret", "block",
        F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
    )
    schema = "a string, b string, n double, sx double, sy double, sxx double, syy double, sxy double"
    return spread.groupBy("first", "second").applyInPandas(_pair_sums, schema)


def _moment(x: str, y: str, xy: str) -> Column:
    return F.col(xy) - F.col(x) * F.col(y) / F.col("n")


def covariance(returns: DataFrame, keys, by: str = "symbol", ret: str = "ret", order: str = "date") -> DataFrame:
    """Annualised sample covariance, upper triangle with diagonal. A pair without common dates has
    no row, one with a single common date no value."""
    value = F.when(F.col("n") > 1, _moment("sx", "sy", "sxy") / (F.col("n") - 1) * YEAR)
    return _pairs(returns, keys, by, ret, order).select("a", "b", value.alias("covariance"))


def correlation(returns: DataFrame, keys, by: str = "symbol", ret: str = "ret", order: str = "date") -> DataFrame:
    """Correlation and the distance sqrt((1-ρ)/2)."""
    spread = F.sqrt(_moment("sx", "sx", "sxx")) * F.sqrt(_moment("sy", "sy", "syy"))
    rho = F.when(spread > 0, _moment("sx", "sy", "sxy") / spread)
    df = _pairs(returns, keys, by, ret, order).select("a", "b", rho.alias("correlation"))
    gap = F.greatest((1.0 - F.col("correlation")) / 2.0, F.lit(0.0))
    return df.withColumn("distance", F.when(gap.isNotNull() & F.col("correlation").isNotNull(), F.sqrt(gap)))


def portfolio_returns(
    returns: DataFrame, weights: DataFrame, by: str = "symbol", order: str = "date"
) -> DataFrame:
    """Daily return of one set of weights."""
    return (
        returns.join(weights.select(by, "weight"), by)
        .groupBy(order)
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    )


def portfolio_stats(
    returns: DataFrame,
    weights: DataFrame,
    risk_free: float = 0.0,
    by: str = "symbol",
    order: str = "date",
    compounded: bool = True,
) -> DataFrame:
    """Expected return Σw·μ, volatility and Sharpe ratio."""
    expected = (
        mean_return(returns, by, compounded=compounded)
        .join(weights.select(by, "weight"), by)
        .select(F.sum(F.col("weight") * F.col("mean_return")))
        .scalar()
    )
    daily = portfolio_returns(returns, weights, by, order)
    risk = daily.agg(F.sqrt(F.var_samp("ret") * YEAR).alias("volatility"))
    return risk.select(
        expected.alias("expected_return"), "volatility"
    ).withColumn("sharpe_ratio", (F.col("expected_return") - risk_free) / F.col("volatility"))


def tail_risk(daily: DataFrame, beta: float = 0.95) -> DataFrame:
    """Historical value at risk and the mean loss beyond it, losses positive. ``daily`` has a row per
    day, so its returns, bounded by the calendar, fit one array."""
    row = daily.agg(F.percentile("ret", F.lit(1.0 - beta)).alias("cut"), F.collect_list("ret").alias("all"))
    tail = row.select("cut", F.filter("all", lambda x: x <= F.col("cut")).alias("tail"))
    total = F.aggregate("tail", F.lit(0.0), lambda s, x: s + x)
    return tail.select(
        (-F.col("cut")).alias("var"),
        F.when(F.size("tail") > 0, -total / F.size("tail")).alias("cvar"),
        F.size("tail").cast("long").alias("days"),
    )


def _draw(by: str, candidate: int, seed: int) -> Column:
    """Exponential draw in (0, inf) from a hash of (symbol, candidate, seed): the same for a key
    wherever and whenever it is computed. Normalised, such draws are uniform on the simplex."""
    bits = F.pmod(F.xxhash64(F.col(by), F.lit(candidate), F.lit(seed)), F.lit(1 << 31))
    return -F.ln((bits.cast("double") + 0.5) / float(1 << 31))


def score_candidates(
    returns: DataFrame,
    count: int = 16,
    seed: int = 7,
    beta: float = 0.95,
    gamma: float = 0.1,
    risk_free: float = 0.0,
    by: str = "symbol",
    order: str = "date",
    draw=None,
) -> DataFrame:
    """Return, volatility, Sharpe ratio, CVaR and penalised CVaR of ``count`` random long-only
    weight vectors that sum to one.

    A search, not a solver: the best of many candidates approaches the optimum but need not
    reach it. A weight is a function of (symbol, candidate), so it is computed on the row:
    nothing is joined or multiplied out. One pass gives, per date, the array of all candidates'
    returns; candidates × dates rows follow from that.
    """
    draw = draw or _draw
    w = [draw(by, c, seed) for c in range(count)]
    per_key = mean_return(returns, by)
    # one row of three numbers per candidate: bounded by ``count``
    sums = per_key.agg(
        F.array(*[F.sum(x) for x in w]).alias("total"),
        F.array(*[F.sum(x * F.col("mean_return")) for x in w]).alias("gain"),
        F.array(*[F.sum(x * x) for x in w]).alias("squares"),
    ).first()
    total, gain, squares = (F.lit([float("nan") if x is None else x for x in sums[c]]) for c in ("total", "gain", "squares"))
    daily = returns.groupBy(order).agg(F.array(*[F.sum(x * F.col("ret")) for x in w]).alias("v"))
    long = written(daily, "candidate-days").select(F.posexplode("v").alias("candidate", "raw")).select(
        "candidate", (F.col("raw") / F.element_at(total, F.col("candidate") + 1)).alias("ret")
    )
    cut = long.groupBy("candidate").agg(
        F.percentile("ret", F.lit(1.0 - beta)).alias("cut"),
        F.sqrt(F.var_samp("ret") * YEAR).alias("volatility"),
    )
    # one row per candidate: bounded by ``count``
    tail = (
        long.join(F.broadcast(cut), "candidate")
        .groupBy("candidate", "volatility")
        .agg((-F.avg(F.when(F.col("ret") <= F.col("cut"), F.col("ret")))).alias("cvar"))
    )
    at = F.col("candidate") + 1
    norm = F.element_at(total, at)
    return (
        tail.withColumn("expected_return", F.element_at(gain, at) / norm)
        .withColumn("sharpe_ratio", (F.col("expected_return") - risk_free) / F.col("volatility"))
        .withColumn(
            "penalised_cvar",
            F.col("cvar") + F.lit(gamma) * F.element_at(squares, at) / (norm * norm),
        )
    )


def best_candidate(scored: DataFrame, method: str) -> DataFrame:
    """ef and cla: highest Sharpe ratio; cvar: lowest penalised CVaR, reported as the volatility
    with a Sharpe ratio of 0."""
    if method in ("ef", "cla"):
        best = scored.orderBy(F.col("sharpe_ratio").desc(), "candidate").limit(1)
        return best.select("candidate", "expected_return", "volatility", "sharpe_ratio")
    if method == "cvar":
        best = scored.orderBy("penalised_cvar", "candidate").limit(1)
        return best.select(
            "candidate", "expected_return", F.col("cvar").alias("volatility"),
            F.lit(0.0).alias("sharpe_ratio"),
        )
    raise ValueError(f"unknown method: {method}")


def candidate_weights(
    keys: DataFrame, best: DataFrame, count: int = 16, seed: int = 7, by: str = "symbol", draw=None
) -> DataFrame:
    """The winning candidate's weight for every key."""
    draw = draw or _draw
    chosen = best.select("candidate").scalar()
    drawn = F.element_at(F.array(*[draw(by, c, seed) for c in range(count)]), chosen + 1)
    raw = keys.select(by).distinct().withColumn("_w", drawn)
    return raw.select(by, (F.col("_w") / raw.select(F.sum("_w")).scalar()).alias("weight"))


def clean_weights(weights: DataFrame, cutoff: float = 1e-4, digits: int = 5) -> DataFrame:
    """Zero tiny weights, round the others, keep the positive ones."""
    w = F.when(F.abs("weight") < cutoff, F.lit(0.0)).otherwise(F.round("weight", digits))
    return weights.withColumn("weight", w).where(F.col("weight") > 0)


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean)/population deviation over the given rows; a zero deviation scales by 1."""
    stats = df.agg(
        F.array(*[F.avg(c) for c in cols]).alias("m"),
        F.array(*[F.stddev_pop(c) for c in cols]).alias("s"),
    )
    mean, sd = stats.select("m").scalar(), stats.select("s").scalar()
    out = {}
    for i, c in enumerate(cols):
        d = F.element_at(sd, i + 1)
        out[c] = (F.col(c) - F.element_at(mean, i + 1)) / F.when(d == 0, F.lit(1.0)).otherwise(d)
    return df.withColumns(out)


def slice_of(gap: Column, deviation: Column, slices: int = 64) -> Column:
    """A rising step function of a value's distance from its group's mean: a logistic curve cut
    into ``slices`` steps."""
    z = F.coalesce(gap / F.nullif(deviation, F.lit(0.0)), F.lit(0.0))
    return F.floor(F.lit(float(slices)) / (1.0 + F.exp(-1.7 * z)))


def percent_rank_by(
    df: DataFrame, group: Sequence[str], value: str, out: str, slice_col: str
) -> DataFrame:
    """percent_rank of ``value`` within ``group`` without sorting a whole group in one task.

    ``slice_col`` holds any rising function of the value (see ``slice_of``). Rows are dealt by group and slice once. A value's
    rank is the count of lower slices plus the count of lower values within its slice; the slices only place the
    work, so the rank is exact however even they turn out. Missing values have none and count for none.
    """
    group = list(group)
    dealt = df.repartition(*group, slice_col)
    inside = Window.partitionBy(*group, slice_col).orderBy(F.col(value).asc_nulls_last())
    # one row per slice of a group
    sizes = dealt.groupBy(*group, slice_col).agg(F.count(value).alias("_sn"))
    up = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group,
        slice_col,
        F.coalesce(F.sum("_sn").over(up), F.lit(0)).alias("_before"),
        F.sum("_sn").over(Window.partitionBy(*group)).alias("_total"),
    )
    lower = F.col("_before") + F.col("_lower")
    rank = lower / F.greatest(F.col("_total") - 1, F.lit(1))
    ranked = dealt.withColumn("_lower", F.rank().over(inside) - 1).join(offsets, [*group, slice_col], "left")
    return ranked.withColumn(out, F.when(F.col(value).isNotNull(), rank)).select(*df.columns, out)
