"""Shared SQL fragments of the oracle texts (DuckDB dialect)."""

from __future__ import annotations

from barline.catalog.registry import rsql

BARS = """
bars AS MATERIALIZED (
  SELECT symbol, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, k) AS close, sum(qty) AS volume
  FROM (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
               l_extendedprice / l_quantity AS price, l_quantity AS qty,
               row(l_orderkey, l_linenumber, l_partkey) AS k
        FROM lineitem)
  GROUP BY symbol, date)"""

# bars with their index per symbol
B = BARS + """,
b AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS rn
  FROM bars)"""

# bars whose first three closes and, for every third symbol, the one at index 40 are missing: b holds
# what the averages may use, counted from the first close on
B_GAPS = BARS + """,
all_b AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS rn
  FROM bars),
b AS MATERIALIZED (
  SELECT * REPLACE (rn - 3 AS rn) FROM all_b
  WHERE rn >= 3 AND (rn < 40 OR CAST(substr(symbol, 2) AS BIGINT) % 3 <> 0))"""

# the dense grid: every symbol on every day, backward fill then forward fill
DENSE = BARS + """,
cal AS (
  SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS rn
  FROM (SELECT DISTINCT date FROM bars)),
holes AS (
  SELECT s.symbol, c.date, c.rn, b.open, b.high, b.low, b.close, b.volume
  FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal c
  LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = c.date),
dense AS MATERIALIZED (
  SELECT symbol, date, rn,
    coalesce(first_value(open IGNORE NULLS) OVER nx, last_value(open IGNORE NULLS) OVER pv) AS open,
    coalesce(first_value(high IGNORE NULLS) OVER nx, last_value(high IGNORE NULLS) OVER pv) AS high,
    coalesce(first_value(low IGNORE NULLS) OVER nx, last_value(low IGNORE NULLS) OVER pv) AS low,
    coalesce(first_value(close IGNORE NULLS) OVER nx, last_value(close IGNORE NULLS) OVER pv) AS close,
    coalesce(first_value(volume IGNORE NULLS) OVER nx, last_value(volume IGNORE NULLS) OVER pv) AS volume
  FROM holes
  WINDOW nx AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         pv AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

POSITIONS = """
positions AS MATERIALIZED (
  SELECT l_orderkey * 10000000 + l_partkey AS id, 'S' || l_suppkey AS ticker,
         CAST(l_quantity AS DOUBLE) AS quantity,
         round(l_extendedprice / l_quantity * 1000000.0::DOUBLE) / 1000000.0::DOUBLE AS purchase_price,
         CAST(l_shipdate AS DATE) AS purchase_date, l_linestatus AS notes
  FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 1)"""

PRICED = BARS + "," + POSITIONS + """,
prices AS (
  SELECT symbol, arg_max(close, date) AS price FROM bars
  WHERE date BETWEEN DATE '2001-06-27' AND DATE '2001-06-30' GROUP BY symbol),
priced AS MATERIALIZED (
  SELECT p.*, coalesce(q.price, p.purchase_price) AS current_price
  FROM positions p LEFT JOIN prices q ON q.symbol = p.ticker)"""

TRANSACTIONS = """
transactions AS MATERIALIZED (
  SELECT (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS id,
         'S' || l_suppkey AS ticker,
         CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS transaction_type,
         CAST(l_quantity AS DOUBLE) AS quantity,
         round(l_extendedprice / l_quantity * 1000000.0::DOUBLE) / 1000000.0::DOUBLE AS price,
         CASE WHEN l_returnflag = 'R'
              THEN round(l_extendedprice / l_quantity * (1 + l_discount) * 1000000.0::DOUBLE) / 1000000.0::DOUBLE END AS close_price,
         CAST(l_shipdate AS DATE) AS transaction_date, round(l_tax * 10, 2) AS fees,
         l_linestatus AS notes
  FROM lineitem WHERE l_returnflag IN ('A', 'R'))"""

SECTORS = """
sector AS MATERIALIZED (
  SELECT r_regionkey AS id, 3 AS level, 'region' AS type, r_name AS name,
         (SELECT sum(s_acctbal) FROM supplier JOIN nation ON s_nationkey = n_nationkey
          WHERE n_regionkey = r_regionkey) AS vonhoa_d
  FROM region
  UNION ALL
  SELECT n_nationkey, 4, 'nation', n_name,
         (SELECT sum(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey)
  FROM nation),
stock_symbol AS MATERIALIZED (
  SELECT s_suppkey AS id, 'S' || s_suppkey AS symbol, s_name AS name,
         n_regionkey AS id_sector_level_3, s_nationkey AS id_sector_level_4,
         s_acctbal AS vonhoa_d
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""

SECTOR_INDEX = BARS + """,
member AS (
  SELECT 'S' || s_suppkey AS symbol, n_nationkey, n_name, r_regionkey, r_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sector_index AS MATERIALIZED (
  SELECT 3 AS sector_type, r_regionkey AS sector_id, r_name AS sector_name, date,
         sum(close * volume) / sum(volume) AS close
  FROM bars JOIN member USING (symbol) GROUP BY ALL
  UNION ALL
  SELECT 4, n_nationkey, n_name, date, sum(close * volume) / sum(volume)
  FROM bars JOIN member USING (symbol) GROUP BY ALL)"""

REPORTS = """
reports AS MATERIALIZED (
  SELECT event_id % 5000 AS id, 'S' || user_id AS mack,
         event_type || ' ' || event_id AS tenbaocao, 'r/' || event_id AS url,
         event_type AS nguon,
         CASE WHEN event_id % 50 <> 0
              THEN ts - to_days(CAST(10400 - event_id % 2400 AS INTEGER)) END AS ngaykn
  FROM events),
latest AS MATERIALIZED (
  SELECT id, mack, tenbaocao, url, nguon, ngaykn FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY ngaykn DESC NULLS LAST, url DESC) AS k
    FROM reports) WHERE k = 1)"""

RETURNS = DENSE + """,
returns AS MATERIALIZED (
  SELECT * FROM (
    SELECT symbol, date, rn,
           close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret FROM dense)
  WHERE ret IS NOT NULL)"""


KALMAN = """
kf AS (
  SELECT symbol, rn, 0.5::DOUBLE * close AS y, 0.5::DOUBLE AS p FROM b WHERE rn = 0
  UNION ALL
  SELECT b.symbol, b.rn,
    k.y + (k.p + 0.01::DOUBLE) / (k.p + 1.01::DOUBLE) * (b.close - k.y),
    (k.p + 0.01::DOUBLE) / (k.p + 1.01::DOUBLE)
  FROM kf k JOIN b ON b.symbol = k.symbol AND b.rn = k.rn + 1)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    """WITH clause of the given fragments."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(c.strip() for c in ctes)


def smooth(
    name: str, src: str, value: str, n: int, start: int = 0, wilder: bool = False, first: bool = False
) -> str:
    """Recursive CTE ``name(symbol, rn, y)``: an exponential average stepped bar by bar."""
    alpha = f"(1.0::DOUBLE / {n})" if wilder else f"(2.0::DOUBLE / {n + 1})"
    if first:
        seed = f"SELECT symbol, rn, CAST({value} AS DOUBLE) AS y FROM {src} WHERE rn = {start}"
    else:
        last = start + n - 1
        seed = (
            f"SELECT symbol, {last} AS rn, avg({value}) AS y FROM {src} "
            f"WHERE rn BETWEEN {start} AND {last} GROUP BY symbol HAVING count(*) = {n}"
        )
    return (
        f"{name} AS ({seed} UNION ALL SELECT s.symbol, s.rn, p.y + {alpha} * (s.{value} - p.y) "
        f"FROM {name} p JOIN {src} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"
    )


def true_range(name: str, src: str, first_bar: bool) -> str:
    head = "high - low" if first_bar else "CAST(NULL AS DOUBLE)"
    return f"""{name} AS MATERIALIZED (
  SELECT *, CASE WHEN pc IS NULL THEN {head}
                 ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS pc FROM {src}))"""


def trail(name: str, src: str, mult: float) -> str:
    """Recursive CTE of the trailing stop; src has symbol, rn, close, atr (NULL while warming up).
    A NULL comparison falls to the last branch, like a NaN one does."""
    m = f"{mult}::DOUBLE"
    return f"""{name} AS (
  SELECT symbol, rn, close, CAST(NULL AS DOUBLE) AS t FROM {src} WHERE rn = 0
  UNION ALL
  SELECT s.symbol, s.rn, s.close,
    CASE WHEN s.close > p.t AND p.close > p.t THEN greatest(p.t, s.close - s.atr * {m})
         WHEN s.close < p.t AND p.close < p.t THEN least(p.t, s.close + s.atr * {m})
         WHEN s.close > p.t THEN s.close - s.atr * {m}
         ELSE s.close + s.atr * {m} END
  FROM {name} p JOIN {src} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


def anchored_vwap(name: str, src: str, side: str, window: int = 200) -> str:
    """CTEs ending in ``name(symbol, rn, x)``."""
    pick, tie = ("max", "-rn") if side == "highest" else ("min", "rn")
    sign = "-" if side == "highest" else ""
    return f"""{name}_a AS MATERIALIZED (
  SELECT symbol, rn, CASE WHEN rn >= {window - 1} THEN {sign}(m.i) END AS a FROM (
    SELECT symbol, rn, {pick}({{'v': close, 'i': {tie}}}) OVER (
      PARTITION BY symbol ORDER BY rn ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS m
    FROM {src})),
{name}_0 AS (SELECT symbol, min(rn) AS i0 FROM {name}_a WHERE a = rn GROUP BY symbol),
{name}_k AS (SELECT DISTINCT symbol, a FROM {name}_a JOIN {name}_0 USING (symbol) WHERE rn >= i0),
{name}_s AS MATERIALIZED (
  SELECT s.symbol, s.rn, s.high, s.low, s.close, s.volume,
         last_value(k.a IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY s.rn) AS a
  FROM {src} s LEFT JOIN {name}_k k ON k.symbol = s.symbol AND k.a = s.rn),
{name}_x AS MATERIALIZED (
  SELECT symbol, rn, CASE WHEN a IS NOT NULL THEN
    sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) END AS x
  FROM {name}_s WINDOW w AS (PARTITION BY symbol, a ORDER BY rn)),
{name} AS MATERIALIZED (
  SELECT symbol, rn, coalesce(
    first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn
                                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS x
  FROM {name}_x)"""


def relation(x: str, y: str) -> str:
    """Sign of x - y where a relative gap of 1e-9 is a tie."""
    return f"CASE WHEN abs({x} - {y}) <= 1e-9 * greatest(abs({x}), abs({y})) THEN 0 ELSE sign({x} - {y}) END"


def flat_mean(value: str, over: str) -> str:
    """Rolling mean that is exact on flat windows."""
    return (
        f"CASE WHEN max({value}) OVER {over} = min({value}) OVER {over} "
        f"THEN {value} ELSE avg({value}) OVER {over} END"
    )


def cols(digits: int = 4, **exprs: str) -> str:
    """Rounded select list."""
    return ", ".join(f"{rsql(e, digits)} AS {n}" for n, e in exprs.items())
