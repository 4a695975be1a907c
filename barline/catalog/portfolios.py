"""Lots, transactions and table edits."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from barline.catalog.registry import SQL, query, r, tidy
from barline.catalog.sql import POSITIONS, PRICED, TRANSACTIONS, cols, with_
from barline.functions import scalars as S
from barline.operators import pages, portfolio, tables
from barline.session import checkpoint_dir
from barline.sources import derived, stored

AS_OF = date(2001, 6, 30)


def _priced(spark, sf):
    return portfolio.price_positions(
        derived.positions(spark, sf), derived.bars(spark, sf), AS_OF, 3
    )


@query(
    "priced_positions",
    with_(PRICED)
    + f""" SELECT id, ticker, {cols(purchase_price="purchase_price", current_price="current_price")}
    FROM priced""",
)
def priced_positions(spark, sf):
    return tidy(_priced(spark, sf), "id", "ticker", "purchase_price", "current_price")


@query(
    "unrealized_profit",
    with_(PRICED)
    + f""" SELECT id, ticker, {cols(3, cost_basis="purchase_price * quantity",
      current_value="current_price * quantity",
      unrealized_pl="(current_price - purchase_price) * quantity",
      unrealized_pct="(current_price / purchase_price - 1) * 100")} FROM priced""",
)
def unrealized_profit(spark, sf):
    df = portfolio.lot_profit(_priced(spark, sf))
    names = ["cost_basis", "current_value", "unrealized_pl", "unrealized_pct"]
    return tidy(df, "id", "ticker", *names, digits=3)


@query(
    "portfolio_summary",
    with_(PRICED)
    + f""", t AS (SELECT sum(current_price * quantity) AS v, sum(purchase_price * quantity) AS i FROM priced)
    SELECT {cols(2, total_value="v", total_invested="i", total_profit_loss="v - i",
      total_profit_loss_pct="CASE WHEN i > 0 THEN (v / i - 1) * 100 ELSE 0 END")} FROM t""",
)
def portfolio_summary(spark, sf):
    return tidy(portfolio.portfolio_summary(_priced(spark, sf)), digits=2)


_BY_TICKER = """
per AS (SELECT ticker, sum(floor(quantity + 0.5)) AS q, sum(floor(purchase_price * quantity + 0.5)) AS c,
  sum(floor(current_price * quantity + 0.5)) AS v,
  sum(floor(current_price * quantity - purchase_price * quantity + 0.5)) AS g
  FROM priced GROUP BY ticker)"""


@query(
    "positions_by_ticker",
    with_(PRICED, _BY_TICKER)
    + f""" SELECT ticker, {cols(total_quantity="q", total_cost_basis="c", total_current_value="v",
      total_unrealized_gain="g", return_pct="(v / nullif(c, 0) - 1) * 100")} FROM per""",
)
def positions_by_ticker(spark, sf):
    return tidy(portfolio.by_ticker(_priced(spark, sf)))


@query(
    "top_and_bottom_tickers",
    with_(PRICED, _BY_TICKER)
    + f""", x AS (SELECT ticker, (v / nullif(c, 0) - 1) * 100 AS return_pct FROM per)
    (SELECT 'top' AS side, ticker, {cols(return_pct="return_pct")} FROM x ORDER BY x.return_pct DESC, ticker LIMIT 5)
    UNION ALL
    (SELECT 'bottom', ticker, {cols(return_pct="return_pct")} FROM x ORDER BY x.return_pct, ticker LIMIT 5)""",
)
def top_and_bottom_tickers(spark, sf):
    df = portfolio.top_and_bottom(portfolio.by_ticker(_priced(spark, sf)))
    return tidy(df, "side", "ticker", "return_pct")


@query(
    "portfolio_weights",
    with_(PRICED)
    + f""" SELECT ticker, {cols(6, total_quantity="sum(quantity)", weight='''sum(current_price * quantity)
      / (SELECT sum(current_price * quantity) FROM priced)''')} FROM priced GROUP BY ticker""",
)
def portfolio_weights(spark, sf):
    return tidy(
        portfolio.weights(_priced(spark, sf)), "ticker", "total_quantity", "weight", digits=6
    )


@query(
    "realized_profit",
    with_(TRANSACTIONS)
    + f""" SELECT id, ticker, transaction_type,
      {cols(3, realized_pl="(coalesce(nullif(close_price, 0), price) - price) * quantity - fees")}
    FROM transactions""",
)
def realized_profit(spark, sf):
    df = portfolio.realized_pl(derived.transactions(spark, sf))
    return tidy(df, "id", "ticker", "transaction_type", "realized_pl", digits=3)


# Requests in sequence per lot: half first, then the second one of the kind its id decides.
_CLOSES = """
pq AS (SELECT id, ticker, CAST(quantity AS DECIMAL(15,6)) AS q,
  CAST(quantity / 2 AS DECIMAL(15,6)) AS half,
  CAST(purchase_price AS DECIMAL(15,6)) AS buy, purchase_date,
  CAST(CAST(purchase_price AS DECIMAL(15,6)) * 1.10::DECIMAL(5,2) AS DECIMAL(15,6)) AS sell
  FROM positions),
rq AS MATERIALIZED (
  SELECT id * 3 AS seq, id AS pid, half AS want, * FROM pq
  UNION ALL
  SELECT id * 3 + 1, id, CASE id % 3 WHEN 0 THEN q - half WHEN 1 THEN 1 ELSE q + 1 END, * FROM pq
  UNION ALL
  SELECT id * 3 + 2, -id, 1, * FROM pq),
done AS MATERIALIZED (
  SELECT *, CASE WHEN pid <= 0 THEN 'position_id' WHEN want <= q - CASE WHEN seq % 3 = 1 THEN half ELSE 0 END
    THEN 'accepted' ELSE 'over' END AS status FROM rq)"""


@query(
    "close_positions_lots",
    with_(POSITIONS, _CLOSES)
    + f""", c AS (SELECT pid AS id, sum(want) AS w FROM done WHERE status = 'accepted' GROUP BY pid)
    SELECT p.id, p.ticker, {cols(6, quantity="CAST(p.q - coalesce(c.w, 0) AS DOUBLE)")}
    FROM pq p LEFT JOIN c USING (id) WHERE p.q - coalesce(c.w, 0) <> 0""",
)
def close_positions_lots(spark, sf):
    lots, _, _ = portfolio.close_positions(
        derived.positions(spark, sf), derived.close_requests(spark, sf)
    )
    return tidy(lots, "id", "ticker", "quantity", digits=6)


@query(
    "close_positions_transactions",
    with_(POSITIONS, _CLOSES)
    + f""" SELECT seq AS id, ticker, 'sell' AS transaction_type, purchase_date + 30 AS transaction_date,
      {cols(6, quantity="CAST(want AS DOUBLE)", price="CAST(buy AS DOUBLE)",
      close_price="CAST(sell AS DOUBLE)", fees="1.5::DOUBLE")}
    FROM done WHERE status = 'accepted'""",
)
def close_positions_transactions(spark, sf):
    _, sells, _ = portfolio.close_positions(
        derived.positions(spark, sf), derived.close_requests(spark, sf)
    )
    return tidy(
        sells, "id", "ticker", "transaction_type", "transaction_date", "quantity", "price",
        "close_price", "fees", digits=6,
    )


@query(
    "close_positions_rejected",
    with_(POSITIONS, _CLOSES)
    + " SELECT seq, pid AS position_id, status FROM done WHERE status <> 'accepted'",
)
def close_positions_rejected(spark, sf):
    _, _, refused = portfolio.close_positions(
        derived.positions(spark, sf), derived.close_requests(spark, sf)
    )
    return refused


@query(
    "close_positions_profit",
    with_(POSITIONS, _CLOSES)
    + f""" SELECT seq, pid AS position_id, {cols(3,
      realized_pl="CAST(sell AS DOUBLE) * want - CAST(buy AS DOUBLE) * want - 1.5",
      realized_pl_pct="(CAST(sell AS DOUBLE) / CAST(buy AS DOUBLE) - 1) * 100")}
    FROM done WHERE status = 'accepted'""",
)
def close_positions_profit(spark, sf):
    requests = derived.close_requests(spark, sf)
    done = portfolio.apply_requests(derived.positions(spark, sf), requests)
    return tidy(
        done.where(F.col("status") == "accepted"),
        "seq", "position_id", "realized_pl", "realized_pl_pct", digits=3,
    )


@query(
    "close_preview",
    with_(POSITIONS, _CLOSES)
    + f""" SELECT seq, pid AS position_id, {cols(3,
      pl="CAST(sell AS DOUBLE) * want - CAST(buy AS DOUBLE) * want - 1.5",
      pl_pct="(CAST(sell AS DOUBLE) / CAST(buy AS DOUBLE) - 1) * 100",
      remaining="CAST(q AS DOUBLE) - want")}
    FROM rq WHERE pid > 0""",
)
def close_preview(spark, sf):
    df = portfolio.preview_close(
        derived.positions(spark, sf), derived.close_requests(spark, sf)
    )
    return tidy(df, "seq", "position_id", "pl", "pl_pct", "remaining", digits=3)


@query(
    "constant_price_history",
    with_(PRICED)
    + f""", d AS (SELECT CAST(unnest(generate_series(DATE '2001-06-01', DATE '2001-06-30', INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT date, ticker, {cols(close="close")} FROM d,
      (SELECT ticker, arg_max(current_price, id) AS close FROM priced GROUP BY ticker)
    WHERE isodow(date) < 6""",
)
def constant_price_history(spark, sf):
    return tidy(portfolio.constant_history(_priced(spark, sf), date(2001, 6, 1), AS_OF))


# --- validation and normalisation ----------------------------------------------------------

_RULES = """
raw AS (SELECT l_orderkey AS id, l_linenumber, l_partkey,
  CASE WHEN l_tax = 0 THEN 'S' || l_suppkey || 'XXXXXXXXXX' ELSE 'S' || l_suppkey END AS ticker,
  CASE WHEN l_linenumber = 7 THEN 'hold' ELSE 'buy' END AS transaction_type,
  l_quantity - 2 AS quantity, l_extendedprice AS price, l_discount - 0.01 AS fees FROM lineitem),
why AS (SELECT *, list_filter([
  CASE WHEN length(ticker) NOT BETWEEN 1 AND 10 THEN 'ticker length' END,
  CASE WHEN transaction_type NOT IN ('buy', 'sell') THEN 'transaction_type' END,
  CASE WHEN NOT quantity > 0 THEN 'quantity' END,
  CASE WHEN NOT price > 0 THEN 'price' END,
  CASE WHEN NOT fees >= 0 THEN 'fees' END], lambda x: x IS NOT NULL) AS w FROM raw)"""


def _raw_transactions(spark, sf):
    li = derived.table(spark, sf, "lineitem")
    ticker = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    return li.select(
        F.col("l_orderkey").alias("id"),
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_tax") == 0, F.concat(ticker, F.lit("X" * 10))).otherwise(ticker).alias("ticker"),
        F.when(F.col("l_linenumber") == 7, F.lit("hold")).otherwise(F.lit("buy")).alias("transaction_type"),
        (F.col("l_quantity") - 2).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_discount") - 0.01).alias("fees"),
        F.to_date("l_shipdate").alias("transaction_date"),
    )


@query(
    "valid_transactions",
    with_(_RULES)
    + """ SELECT id, l_linenumber, l_partkey, ticker FROM why WHERE len(w) = 0""",
)
def valid_transactions(spark, sf):
    checked = tables.validate(_raw_transactions(spark, sf), tables.transaction_checks())
    return tables.valid_rows(checked).select("id", "l_linenumber", "l_partkey", "ticker")


@query(
    "rejected_transactions",
    with_(_RULES)
    + """ SELECT id, l_linenumber, l_partkey, array_to_string(w, ', ') AS reasons
    FROM why WHERE len(w) > 0""",
)
def rejected_transactions(spark, sf):
    checked = tables.validate(_raw_transactions(spark, sf), tables.transaction_checks())
    return tables.rejected_rows(checked).select(
        "id", "l_linenumber", "l_partkey", F.array_join("reasons", ", ").alias("reasons")
    )


@query(
    "valid_positions",
    with_(POSITIONS) + " SELECT id, ticker FROM positions WHERE quantity > 0 AND purchase_price > 0",
)
def valid_positions(spark, sf):
    checked = tables.validate(derived.positions(spark, sf), tables.position_checks())
    return tables.valid_rows(checked).select("id", "ticker")


@query(
    "normalized_input",
    f"""SELECT l_orderkey AS id, l_linenumber, l_partkey, 'S' || l_suppkey AS ticker,
      CAST(floor(l_quantity / 3) AS BIGINT) AS quantity,
      {cols(2, purchase_price="round(l_extendedprice / 7, 2)")} FROM lineitem""",
)
def normalized_input(spark, sf):
    raw = derived.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        "l_linenumber",
        "l_partkey",
        F.concat(F.lit("  s"), F.col("l_suppkey").cast("string"), F.lit(" ")).alias("ticker"),
        (F.col("l_quantity") / 3).alias("quantity"),
        (F.col("l_extendedprice") / 7).alias("purchase_price"),
    )
    out = tables.normalize_positions(raw)
    return out.select(
        "id", "l_linenumber", "l_partkey", "ticker", F.col("quantity").cast("bigint"),
        r("purchase_price", 2).alias("purchase_price"),
    )


# --- table edits ---------------------------------------------------------------------------

_SECOND = "(SELECT * FROM positions WHERE notes = 'O')"


@query(
    "position_lookup",
    with_(POSITIONS, TRANSACTIONS)
    + """ SELECT id, ticker FROM positions
    WHERE ticker IN (SELECT ticker FROM transactions WHERE transaction_type = 'sell')""",
)
def position_lookup(spark, sf):
    sold = derived.transactions(spark, sf).where(F.col("transaction_type") == "sell")
    keys = sold.select("ticker").distinct()
    return tables.lookup(derived.positions(spark, sf), keys).select("id", "ticker")


@query(
    "append_transactions",
    with_(POSITIONS, TRANSACTIONS)
    + f""" SELECT id, ticker, transaction_type, {cols(quantity="quantity")} FROM transactions
    UNION ALL SELECT -id, ticker, 'buy', {cols(quantity="quantity")} FROM positions""",
)
def append_transactions(spark, sf):
    new = derived.positions(spark, sf).select(
        (-F.col("id")).alias("id"),
        "ticker",
        F.lit("buy").alias("transaction_type"),
        "quantity",
        F.col("purchase_price").alias("price"),
    )
    df = tables.append(derived.transactions(spark, sf), new)
    return tidy(df, "id", "ticker", "transaction_type", "quantity")


@query(
    "delete_positions",
    with_(POSITIONS) + " SELECT id, ticker FROM positions WHERE notes <> 'O'",
)
def delete_positions(spark, sf):
    lots = derived.positions(spark, sf)
    gone = lots.where(F.col("notes") == "O").select("id")
    return tables.delete_by_key(lots, gone).select("id", "ticker")


@query(
    "replace_positions",
    with_(POSITIONS)
    + f""" SELECT id, CASE WHEN notes = 'O' THEN 'NEW' ELSE ticker END AS ticker,
      {cols(quantity="CASE WHEN notes = 'O' THEN quantity * 2 ELSE quantity END")},
      CASE WHEN notes = 'O' THEN NULL ELSE notes END AS notes FROM positions""",
)
def replace_positions(spark, sf):
    lots = derived.positions(spark, sf)
    return tidy(tables.replace_by_key(lots, _changed_lots(lots), "seq"), "id", "ticker", "quantity", "notes")


def _changed_lots(lots):
    rows = lots.where(F.col("notes") == "O")
    # Every key three times; the last write is the one to see.
    return rows.select("id", F.explode(F.array(*[F.lit(k) for k in (2, 3, 1)])).alias("seq"), "quantity").select(
        "id",
        "seq",
        F.when(F.col("seq") == 3, F.lit("NEW")).otherwise(F.lit("EARLIER")).alias("ticker"),
        (F.col("quantity") * (F.col("seq") - 1)).cast("decimal(15,6)").alias("quantity"),
        F.when(F.col("seq") < 3, F.lit("earlier")).alias("notes"),
    )


@query("merged_positions", SQL["replace_positions"])
def merged_positions(spark, sf):
    """The same edits merged into a stored table, which is then read back."""
    lots = derived.positions(spark, sf)
    path = f"{checkpoint_dir(spark)}/positions-{uuid.uuid4().hex}"
    stored.write_keyed(lots, path, ["id"], 16)
    rows = _changed_lots(lots)
    stored.merge_keyed(spark, path, lots.schema, rows, ["id"], lambda old, new: tables.replace_by_key(old, new, "seq"), 16)
    return tidy(stored.read_keyed(spark, path, lots.schema), "id", "ticker", "quantity", "notes")


@query(
    "latest_amount",
    f"""SELECT o_orderkey AS id, {cols(2, amount="o_totalprice")}, CAST(o_orderdate AS DATE) AS date
    FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""",
)
def latest_amount(spark, sf):
    df = tables.latest_row(derived.investment_amounts(spark, sf))
    return tidy(df, "id", "amount", "date", digits=2)


@query(
    "set_latest_amount",
    f"""WITH l AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1),
    m AS (SELECT max(o_totalprice) AS x FROM orders)
    SELECT o_orderkey AS id, {cols(2, amount="CASE WHEN o_orderkey IN (FROM l) THEN x ELSE o_totalprice END")}
    FROM orders, m""",
)
def set_latest_amount(spark, sf):
    df = derived.investment_amounts(spark, sf)
    row = df.agg(F.max("amount").alias("amount"), F.max("date").alias("date"))
    return tidy(tables.set_latest_amount(df, row), "id", "amount", digits=2)


@query(
    "deduplicated_transactions",
    with_(TRANSACTIONS)
    + f""" SELECT ticker, transaction_type, id, {cols(price="price")} FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker, transaction_type
        ORDER BY transaction_date, id) AS k FROM transactions) WHERE k = 1""",
)
def deduplicated_transactions(spark, sf):
    df = derived.transactions(spark, sf)
    order = [F.col("transaction_date"), F.col("id")]
    out = tables.dedup_first(df, ["ticker", "transaction_type"], order)
    return tidy(out, "ticker", "transaction_type", "id", "price")


@query(
    "transactions_newest_first",
    with_(TRANSACTIONS)
    + """ SELECT id, ticker, transaction_date FROM transactions ORDER BY transaction_date DESC, id""",
)
def transactions_newest_first(spark, sf):
    df = derived.transactions(spark, sf).select("id", "ticker", "transaction_date")
    return df.orderBy(F.col("transaction_date").desc(), "id")


@query(
    "positions_by_name",
    with_(POSITIONS) + " SELECT id, ticker FROM positions ORDER BY ticker, id",
)
def positions_by_name(spark, sf):
    return derived.positions(spark, sf).select("id", "ticker").orderBy("ticker", "id")


@query(
    "transaction_page",
    with_(TRANSACTIONS)
    + """ SELECT id, ticker, transaction_date FROM transactions
    ORDER BY transaction_date DESC, id LIMIT 25 OFFSET 50""",
)
def transaction_page(spark, sf):
    df = derived.transactions(spark, sf).select("id", "ticker", "transaction_date")
    return tables.page(df, [F.col("transaction_date").desc(), F.col("id")], 2, 25)


@query(
    "deep_transaction_page",
    with_(TRANSACTIONS)
    + """ SELECT id, ticker, transaction_date FROM transactions
    ORDER BY transaction_date DESC, id LIMIT 25 OFFSET (SELECT 25 * (count(*) // 50) FROM transactions)""",
)
def deep_transaction_page(spark, sf):
    """The page in the middle of all transactions."""
    df = derived.transactions(spark, sf).select("id", "ticker", "transaction_date")
    index = pages.numbered(df, [F.col("transaction_date").desc(), F.col("id")])
    return index.page(df.count() // 50, 25)


@query(
    "numbered_transactions",
    with_(TRANSACTIONS)
    + """ SELECT id, row_number() OVER (ORDER BY transaction_date DESC, id) - 1 AS number FROM transactions""",
)
def numbered_transactions(spark, sf):
    df = derived.transactions(spark, sf).select("id", "transaction_date")
    return pages.numbered(df, [F.col("transaction_date").desc(), F.col("id")]).numbers().drop("transaction_date")


@query(
    "next_transactions",
    with_(TRANSACTIONS)
    + """ SELECT id, ticker, transaction_date FROM transactions WHERE transaction_date < DATE '1996-01-01'
    ORDER BY transaction_date DESC, id LIMIT 25""",
)
def next_transactions(spark, sf):
    """The page after the last transaction of a given day, by its key."""
    df = derived.transactions(spark, sf).select("id", "ticker", "transaction_date")
    return pages.next_page(df, [("transaction_date", True), ("id", False)], [date(1996, 1, 1), 2**62])


@query(
    "close_price_or_price",
    with_(TRANSACTIONS)
    + f""" SELECT id, {cols(sold="coalesce(nullif(close_price, 0), price)",
      whole="floor(price - 500.5 + 0.5)")} FROM transactions""",
)
def close_price_or_price(spark, sf):
    df = derived.transactions(spark, sf)
    sold = F.coalesce(S.zero_to_null(F.col("close_price").cast("double")), F.col("price").cast("double"))
    return df.select(
        "id",
        r(sold).alias("sold"),
        r(S.js_round(F.col("price").cast("double") - 500.5)).alias("whole"),
    )
