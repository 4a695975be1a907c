"""Returns, risk and candidate portfolios."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barline.catalog.registry import query, tidy
from barline.catalog.sql import RETURNS, SECTOR_INDEX, cols, with_
from barline.operators import indicators, risk
from barline.plans.optimize import dense_returns, optimize, search
from barline.session import written
from barline.sources import derived
from barline.sources import tables as scans


def _returns(spark, sf):
    return dense_returns(derived.bars_by_symbol(spark, sf, derived.DENSE_PART), seen=derived.ticks(spark, sf))


_MU = """
mu AS MATERIALIZED (SELECT symbol, exp(sum(ln(1 + ret)) * 252.0::DOUBLE / count(*)) - 1 AS m
  FROM returns GROUP BY symbol)"""
_EQUAL = "w AS (SELECT DISTINCT symbol, 1.0::DOUBLE / (SELECT count(DISTINCT symbol) FROM returns) AS w FROM returns)"
_DAILY = "daily AS MATERIALIZED (SELECT rn, sum(w * ret) AS ret FROM returns JOIN w USING (symbol) GROUP BY rn)"


def _equal(returns):
    keys = returns.select("symbol").distinct()
    return keys.withColumn("weight", 1.0 / keys.select(F.count("*").cast("double")).scalar())


@query("mean_return", with_(RETURNS, _MU) + f" SELECT symbol, {cols(mean_return='m')} FROM mu")
def mean_return(spark, sf):
    return tidy(risk.mean_return(_returns(spark, sf)))


@query(
    "inverse_variance_weights",
    with_(RETURNS)
    + f""", v AS (SELECT symbol, var_samp(ret) AS v FROM returns GROUP BY symbol)
    SELECT symbol, {cols(6, weight="1 / v / (SELECT sum(1 / v) FROM v WHERE v > 0)")} FROM v WHERE v > 0""",
)
def inverse_variance_weights(spark, sf):
    return tidy(risk.inverse_variance(_returns(spark, sf)), "symbol", "weight", digits=6)


@query(
    "clean_weights",
    with_(RETURNS)
    + f""", v AS (SELECT symbol, var_samp(ret) AS v FROM returns GROUP BY symbol),
    w AS (SELECT symbol, 1 / v / (SELECT sum(1 / v) FROM v WHERE v > 0) AS w FROM v WHERE v > 0)
    SELECT symbol, {cols(5, weight="round(w, 5)")} FROM w WHERE w >= 1e-4""",
)
def clean_weights(spark, sf):
    weights = risk.inverse_variance(_returns(spark, sf)).select("symbol", "weight")
    return tidy(risk.clean_weights(weights), "symbol", "weight", digits=5)


_SECTOR_RETURNS = """
sr AS MATERIALIZED (SELECT * FROM (SELECT sector_name, date,
  close / lag(close) OVER (PARTITION BY sector_name ORDER BY date) - 1 AS ret
  FROM sector_index WHERE sector_type = 4) WHERE ret IS NOT NULL)"""


def _sector_returns(spark, sf):
    series = scans.sector_series(derived.sector_index(spark, sf), 4)
    named = series.select(F.col("sector_name").alias("symbol"), "date", "close")
    return indicators.simple_return(named).where(F.col("ret").isNotNull())


def _sector_names(spark, sf):
    return derived.table(spark, sf, "nation").select(F.col("n_name").alias("symbol"))


@query(
    "sector_covariance",
    with_(SECTOR_INDEX, _SECTOR_RETURNS)
    + f""" SELECT x.sector_name AS a, y.sector_name AS b, {cols(covariance="covar_samp(x.ret, y.ret) * 252")}
    FROM sr x JOIN sr y ON x.date = y.date AND x.sector_name <= y.sector_name GROUP BY ALL""",
)
def sector_covariance(spark, sf):
    return tidy(risk.covariance(_sector_returns(spark, sf), _sector_names(spark, sf)))


@query(
    "sector_correlation",
    with_(SECTOR_INDEX, _SECTOR_RETURNS)
    + f""", c AS (SELECT x.sector_name AS a, y.sector_name AS b, corr(x.ret, y.ret) AS c
      FROM sr x JOIN sr y ON x.date = y.date AND x.sector_name <= y.sector_name GROUP BY ALL)
    SELECT a, b, {cols(correlation="c")},
      {cols(distance="CASE WHEN a = b THEN 0 ELSE sqrt(greatest((1 - c) / 2, 0)) END")} FROM c""",
)
def sector_correlation(spark, sf):
    return tidy(risk.correlation(_sector_returns(spark, sf), _sector_names(spark, sf)))


@query(
    "portfolio_stats",
    with_(RETURNS, _MU, _EQUAL, _DAILY)
    + f""", e AS (SELECT sum(w * m) AS e FROM mu JOIN w USING (symbol)),
    v AS (SELECT sqrt(var_samp(ret) * 252) AS v FROM daily)
    SELECT {cols(expected_return="e", volatility="v", sharpe_ratio="(e - 0.02) / v")} FROM e, v""",
)
def portfolio_stats(spark, sf):
    returns = _returns(spark, sf)
    return tidy(risk.portfolio_stats(returns, _equal(returns), 0.02))


@query(
    "portfolio_tail_risk",
    with_(RETURNS, _EQUAL, _DAILY)
    + f""", q AS (SELECT quantile_cont(ret, 0.05::DOUBLE) AS q FROM daily)
    SELECT {cols(var="-any_value(q)", cvar="-avg(ret)")}, count(*) AS days
    FROM daily, q WHERE ret <= q + 1e-12""",
)
def portfolio_tail_risk(spark, sf):
    """The return table and the portfolio's days are written, so the plan scans days only."""
    returns = written(_returns(spark, sf).select("symbol", "rn", "ret"), "returns")
    daily = written(risk.portfolio_returns(returns, _equal(returns), order="rn"), "portfolio-days")
    return tidy(risk.tail_risk(daily))


COUNT = 8


def _number_draw(by: str, candidate: int, seed: int):
    """A draw that SQL can repeat: modular arithmetic on the symbol's number."""
    n = F.substring(by, 2, 12).cast("bigint")
    bits = (n * F.lit(7919) + F.lit(candidate * 104729 + seed * 1299709)) % F.lit(10007)
    return -F.ln((bits.cast("double") + 0.5) / 10007.0)


_CANDIDATES = f"""
cw AS MATERIALIZED (SELECT symbol, c AS candidate,
  -ln((CAST((CAST(substr(symbol, 2) AS BIGINT) * 7919 + c * 104729 + 7 * 1299709) % 10007 AS DOUBLE) + 0.5)
    / 10007) AS u FROM (SELECT DISTINCT symbol FROM returns), generate_series(0, {COUNT - 1}) g(c)),
cn AS (SELECT symbol, candidate, u / sum(u) OVER (PARTITION BY candidate) AS w FROM cw),
cd AS MATERIALIZED (SELECT candidate, rn, sum(w * ret) AS ret FROM returns JOIN cn USING (symbol)
  GROUP BY candidate, rn),
cq AS (SELECT candidate, quantile_cont(ret, 0.05::DOUBLE) AS q FROM cd GROUP BY candidate),
cs AS MATERIALIZED (
  SELECT candidate, any_value(e) AS e, sqrt(var_samp(ret) * 252) AS v,
         -avg(CASE WHEN ret <= q + 1e-12 THEN ret END) AS cvar, any_value(w2) AS w2
  FROM cd JOIN cq USING (candidate)
  JOIN (SELECT candidate, sum(w * m) AS e, sum(w * w) AS w2 FROM cn JOIN mu USING (symbol)
        GROUP BY candidate) USING (candidate)
  GROUP BY candidate)"""


def _scored(spark, sf):
    returns = written(_returns(spark, sf).select("symbol", "rn", "ret"), "returns")
    return risk.score_candidates(returns, COUNT, order="rn", draw=_number_draw)


@query(
    "candidate_scores",
    with_(RETURNS, _MU, _CANDIDATES)
    + f""" SELECT CAST(candidate AS INTEGER) AS candidate, {cols(expected_return="e", volatility="v",
      sharpe_ratio="e / v", cvar="cvar", penalised_cvar="cvar + 0.1 * w2")} FROM cs""",
)
def candidate_scores(spark, sf):
    df = _scored(spark, sf)
    names = ["expected_return", "volatility", "sharpe_ratio", "cvar", "penalised_cvar"]
    return tidy(df, "candidate", *names)


@query(
    "max_sharpe_candidate",
    with_(RETURNS, _MU, _CANDIDATES)
    + f""" SELECT CAST(candidate AS INTEGER) AS candidate, {cols(expected_return="e", volatility="v",
      sharpe_ratio="e / v")} FROM cs ORDER BY e / v DESC, candidate LIMIT 1""",
)
def max_sharpe_candidate(spark, sf):
    return tidy(risk.best_candidate(_scored(spark, sf), "ef"))


@query(
    "min_cvar_candidate",
    with_(RETURNS, _MU, _CANDIDATES)
    + f""" SELECT CAST(candidate AS INTEGER) AS candidate, {cols(expected_return="e", volatility="cvar",
      sharpe_ratio="0.0::DOUBLE")} FROM cs ORDER BY cvar + 0.1 * w2, candidate LIMIT 1""",
)
def min_cvar_candidate(spark, sf):
    return tidy(risk.best_candidate(_scored(spark, sf), "cvar"))


@query(
    "max_sharpe_weights",
    with_(RETURNS, _MU, _CANDIDATES)
    + f""" SELECT symbol, {cols(6, weight="w")} FROM cn
    WHERE candidate = (SELECT candidate FROM cs ORDER BY e / v DESC, candidate LIMIT 1)""",
)
def max_sharpe_weights(spark, sf):
    returns = _returns(spark, sf)
    best = risk.best_candidate(_scored(spark, sf), "ef")
    weights = risk.candidate_weights(returns, best, COUNT, draw=_number_draw)
    return tidy(weights, "symbol", "weight", digits=6)


#: Before all bars.
FIRST = date(1900, 1, 1)
#: Four years and eight months of bars: the default history ends here.
AS_OF = date(1998, 8, 1)

# --- the optimizer as a whole ----------------------------------------------------------------

_INVERSE = """
v AS (SELECT symbol, var_samp(ret) AS v FROM returns GROUP BY symbol),
w AS MATERIALIZED (SELECT symbol, 1 / v / (SELECT sum(1 / v) FROM v WHERE v > 0) AS w FROM v WHERE v > 0)"""


@query("optimize_hrp", with_(RETURNS, _INVERSE) + f" SELECT symbol, {cols(6, weight='w')} FROM w")
def optimize_hrp(spark, sf):
    weights, _ = optimize(derived.bars_by_symbol(spark, sf, derived.DENSE_PART), None, "hrp", FIRST, seen=derived.ticks(spark, sf))
    return tidy(weights, "symbol", "weight", digits=6)


@query(
    "optimize_hrp_figures",
    with_(RETURNS, _INVERSE, _DAILY)
    + f""", m AS (SELECT symbol, avg(ret) * 252 AS m FROM returns GROUP BY symbol),
    e AS (SELECT sum(w * m) AS e FROM m JOIN w USING (symbol)),
    s AS (SELECT sqrt(var_samp(ret) * 252) AS v FROM daily)
    SELECT {cols(expected_return="e", volatility="v", sharpe_ratio="(e - 0.02) / v")} FROM e, s""",
)
def optimize_hrp_figures(spark, sf):
    return tidy(optimize(derived.bars_by_symbol(spark, sf, derived.DENSE_PART), None, "hrp", FIRST, risk_free=0.02, seen=derived.ticks(spark, sf))[1])


def _cleaned(choice: str) -> str:
    return (
        with_(RETURNS, _MU, _CANDIDATES)
        + f""" SELECT symbol, {cols(5, weight="round(w, 5)")} FROM cn
    WHERE candidate = (SELECT candidate FROM cs ORDER BY {choice}, candidate LIMIT 1) AND w >= 1e-4"""
    )


@query("optimize_ef", _cleaned("e / v DESC"))
def optimize_ef(spark, sf):
    """The draw is one that SQL can repeat; the search is the operator's own."""
    weights, _ = search(derived.bars_by_symbol(spark, sf, derived.DENSE_PART), None, "ef", count=COUNT, draw=_number_draw, seen=derived.ticks(spark, sf))
    return tidy(weights, "symbol", "weight", digits=5)


# Least CVaR + 0.1·Σw², a linear-quadratic program: min a + c·Σu + 0.1·w'w over u >= -R'w - a, u >= 0, w >= 0, Σw = 1 with
# c = 1/(n·0.05). An interior-point method: each step solves for all multipliers at once by elimination, towards 0.15 of the
# product that is left. s is the slack of the first condition, q, p and z are the multipliers; after 40 steps nothing is left to gain.
_TAIL_STEPS = 40
_TAIL = f"""
cells AS MATERIALIZED (SELECT symbol, list(ret ORDER BY rn) AS r FROM returns GROUP BY symbol),
names AS MATERIALIZED (SELECT list(r ORDER BY symbol) AS rs, count(*) AS k, any_value(len(r)) AS n FROM cells),
spots AS MATERIALIZED (SELECT list(x ORDER BY rn) AS xs FROM (SELECT rn, list(ret ORDER BY symbol) AS x FROM returns GROUP BY rn)),
begin_at AS (SELECT *, 20.0::DOUBLE / n AS c, list_transform(xs, lambda x: list_sum(x) / k) AS y FROM names, spots),
it AS (
  SELECT 0 AS i, list_transform(range(k), lambda j: 1.0::DOUBLE / k) AS w, list_transform(range(k), lambda j: 0.1::DOUBLE) AS z,
    0.0::DOUBLE AS l, -q5 AS a, y,
    list_transform(y, lambda v: greatest(q5 - v, 0) + near) AS u, list_transform(y, lambda v: greatest(v - q5, 0) + near) AS s,
    list_transform(y, lambda v: 1.0::DOUBLE / n) AS q, list_transform(y, lambda v: c - 1.0::DOUBLE / n) AS p
  FROM (SELECT *, greatest(0.1 * list_avg(list_transform(y, lambda v: abs(v - q5))), 1e-3) AS near
    FROM (SELECT *, list_aggregate(y, 'quantile_cont', 0.05) AS q5 FROM begin_at))
  UNION ALL
  SELECT i + 1, list_transform(list_zip(w, dw), lambda t: t[1] + f * t[2]), list_transform(list_zip(z, dz), lambda t: t[1] + f * t[2]),
    l + f * dl, a + f * da, list_transform(list_zip(y, v), lambda t: t[1] + f * t[2].y),
    list_transform(list_zip(u, v), lambda t: t[1] + f * t[2].u), list_transform(list_zip(s, v), lambda t: t[1] + f * t[2].s),
    list_transform(list_zip(q, v), lambda t: t[1] + f * t[2].q), list_transform(list_zip(p, v), lambda t: t[1] + f * t[2].p)
  FROM (SELECT *, least(1.0, 0.99 / greatest(1e-9,
      list_max(list_transform(list_zip(w, dw), lambda t: -t[2] / t[1])), list_max(list_transform(list_zip(z, dz), lambda t: -t[2] / t[1])),
      list_max(list_transform(list_zip(u, v), lambda t: -t[2].u / t[1])), list_max(list_transform(list_zip(s, v), lambda t: -t[2].s / t[1])),
      list_max(list_transform(list_zip(q, v), lambda t: -t[2].q / t[1])), list_max(list_transform(list_zip(p, v), lambda t: -t[2].p / t[1])))) AS f
  FROM (SELECT *, list_transform(list_zip(d, t1), lambda t: {{'y': t[2].y, 'u': t[2].u, 's': t[2].u + t[2].t,
        'q': t[1].ms - t[1].d1 * (t[2].u + t[2].t), 'p': t[1].mu - t[1].d2 * t[2].u}}) AS v,
      list_transform(list_zip(w, z, dw), lambda t: m / t[1] - t[2] - t[2] / t[1] * t[3]) AS dz
  FROM (SELECT *, list_transform(list_zip(d, yd), lambda t: {{'y': t[2], 't': t[2] + da + t[1].o,
        'u': (t[1].g - t[1].d1 * (t[2] + da + t[1].o)) / (t[1].d1 + t[1].d2)}}) AS t1
  FROM (SELECT *, list_transform(xs, lambda x: list_dot_product(x, dw)) AS yd
  FROM (SELECT *, list_transform(range(1, k + 1), lambda j: got[j][k + 3]) AS dw, got[k + 1][k + 3] AS da, got[k + 2][k + 3] AS dl
  FROM (SELECT *, list_reduce(list_transform(range(1, k + 3), lambda j: {{'j': j, 'm': [[0.0::DOUBLE]]}}),
      lambda b, o: {{'j': o.j, 'm': list_transform(b.m, lambda row, pos: CASE WHEN pos = o.j
        THEN list_transform(row, lambda e: e / row[o.j])
        ELSE list_transform(list_zip(row, b.m[o.j]), lambda t: t[1] - t[2] * (row[o.j] / b.m[o.j][o.j])) END)}},
      {{'j': 0::BIGINT, 'm': mat}}).m AS got
  FROM (SELECT *, list_concat(
      list_transform(list_zip(rs, re, w, z, range(1, k + 1)), lambda t: list_concat(
        list_transform(re, lambda e, j: list_dot_product(t[1], e) + CASE WHEN j = t[5] THEN 0.2::DOUBLE + t[4] / t[3] ELSE 0 END),
        [list_sum(t[2]), -1.0, list_dot_product(t[1], h) + list_dot_product(t[1], q) + l + m / t[3] - 0.2 * t[3]])),
      [list_concat(list_transform(re, lambda e: list_sum(e)), [list_sum(el), 0.0, list_sum(h) - 1 + list_sum(q)]),
       list_concat(list_transform(re, lambda e: -1.0::DOUBLE), [0.0, 0.0, list_sum(w) - 1])]) AS mat
  FROM (SELECT *, list_transform(d, lambda t: t.e) AS el, list_transform(d, lambda t: t.ms - t.d1 * t.g / (t.d1 + t.d2) - t.e * t.o) AS h,
      list_transform(rs, lambda r: list_transform(list_zip(r, d), lambda t: t[1] * t[2].e)) AS re
  FROM (SELECT *, list_transform(list_zip(u, s, q, p, y), lambda t: {{'d1': t[3] / t[2], 'd2': t[4] / t[1], 'e': 1 / (t[2] / t[3] + t[1] / t[4]),
        'ms': m / t[2] - t[3], 'mu': m / t[1] - t[4], 'g': m / t[2] - t[3] + m / t[1] - t[4] - (c - t[3] - t[4]), 'o': t[1] + t[5] + a - t[2]}}) AS d
  FROM (SELECT it.*, names.*, xs, 20.0::DOUBLE / n AS c, 0.15 * (list_dot_product(q, s) + list_dot_product(p, u) + list_dot_product(w, z)) / (2 * n + k) AS m
  FROM it, names, spots WHERE i < {_TAIL_STEPS}))))))))))
)"""


@query(
    "optimize_cvar",
    with_(RETURNS, _TAIL, recursive=True)
    + f""", u AS (SELECT unnest(w) AS w, unnest(range(1, len(w) + 1)) AS j FROM it WHERE i = {_TAIL_STEPS}),
    o AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS j FROM cells)
    SELECT symbol, {cols(5, weight="round(w, 5)")} FROM u JOIN o USING (j) WHERE w >= 1e-4""",
)
def optimize_cvar(spark, sf):
    """The long-only weights of the least penalised CVaR, to the last digit shown."""
    weights, _ = optimize(derived.bars_by_symbol(spark, sf, derived.DENSE_PART), None, "cvar", FIRST, tolerance=1e-11, seen=derived.ticks(spark, sf))
    return tidy(weights, "symbol", "weight", digits=5)


# Best weights: min y'Sy/2 - m'y over y >= 0 by projected gradient steps, each name's scaled by its variance.
_STEPS = 1500
_BEST = f"""
c AS MATERIALIZED (SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) * 252 AS c
  FROM returns x JOIN returns y USING (rn) GROUP BY ALL),
names AS (SELECT a AS symbol FROM c WHERE a = b AND c > 0),
mat AS (SELECT a, list(c ORDER BY b) AS s FROM c WHERE b IN (FROM names) AND a IN (FROM names) GROUP BY a),
z AS MATERIALIZED (SELECT list({{'m': mu.m - RF, 'd': v.c, 's': mat.s}} ORDER BY mat.a) AS z
  FROM mat JOIN mu ON mu.symbol = mat.a JOIN c v ON v.a = mat.a AND v.b = mat.a),
it AS (
  SELECT 0 AS k, list_transform(z, lambda x: greatest(0, x.m / x.d)) AS y, z FROM z
  UNION ALL
  SELECT k + 1, list_transform(list_zip(y, z), lambda p: greatest(0, p[1] - 0.4 * (list_dot_product(p[2].s, y) - p[2].m) / p[2].d)), z
  FROM it WHERE k < {_STEPS}),
last AS MATERIALIZED (SELECT list_transform(y, lambda v: v / list_sum(y)) AS w, z FROM it WHERE k = {_STEPS}),
o AS MATERIALIZED (SELECT w, z, list_sum(list_transform(list_zip(w, z), lambda p: p[1] * p[2].m)) AS e,
  sqrt(list_sum(list_transform(list_zip(w, z), lambda p: p[1] * list_dot_product(p[2].s, w)))) AS v FROM last)"""


def _best(select: str, risk_free: float) -> str:
    return with_(RETURNS, _MU, _BEST.replace("RF", repr(risk_free)), recursive=True) + select


@query(
    "optimal_ef",
    _best(
        f""", u AS (SELECT unnest(w) AS w, unnest(list_transform(range(len(w)), lambda i: i + 1)) AS i FROM o),
    n AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS i FROM names)
    SELECT symbol, {cols(5, weight="round(w, 5)")} FROM u JOIN n USING (i) WHERE w >= 1e-4""",
        0.02,
    ),
)
def optimal_ef(spark, sf):
    """The long-only weights of the highest Sharpe ratio."""
    weights, _ = optimize(derived.bars_by_symbol(spark, sf, derived.DENSE_PART), None, "ef", FIRST, risk_free=0.02, tolerance=1e-9, seen=derived.ticks(spark, sf))
    return tidy(weights, "symbol", "weight", digits=5)


@query(
    "optimal_ef_figures",
    _best(
        f""", g AS (SELECT list_max(list_transform(z, lambda x: x.m - e / v / v * list_dot_product(x.s, w))) AS gap FROM o)
    SELECT {cols(expected_return="e + 0.02", volatility="v", sharpe_ratio="e / v")}, gap <= 1e-6 AS within FROM o, g""",
        0.02,
    ),
)
def optimal_ef_figures(spark, sf):
    """What the weights yield, and whether the duality gap is within its tolerance."""
    _, figures = optimize(derived.bars_by_symbol(spark, sf, derived.DENSE_PART), None, "ef", FIRST, risk_free=0.02, tolerance=1e-9, seen=derived.ticks(spark, sf))
    figures = figures.withColumn("within", F.col("gap") <= 1e-6)
    return tidy(figures, "expected_return", "volatility", "sharpe_ratio", "within")


@query("optimal_cvar")
def optimal_cvar(spark, sf):
    """The weights of the least penalised CVaR over the default history; tests compute their gap anew."""
    weights, _ = optimize(derived.bars_by_symbol(spark, sf, derived.DENSE_PART), None, "cvar", as_of=AS_OF, tolerance=2e-3, seen=derived.ticks(spark, sf))
    return tidy(weights, "symbol", "weight", digits=5)
