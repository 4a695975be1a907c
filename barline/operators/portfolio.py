"""Valuation and closing of lots."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline import schemas
from barline.functions import scalars as S
from barline.operators import tables


def latest_price(
    bars: DataFrame, as_of: date | None = None, max_age_days: int | None = 3, by: str = "symbol"
) -> DataFrame:
    """Latest close per key within ``max_age_days`` calendar days up to ``as_of``, inclusive.

    The date range reaches the scan; ``max_by`` aggregates map-side."""
    if as_of is not None:
        end = F.lit(as_of).cast("date")
        bars = bars.where(F.col("date") <= end)
        if max_age_days is not None:
            bars = bars.where(F.col("date") >= F.date_sub(end, max_age_days))
    return bars.groupBy(by).agg(
        F.max_by("close", "date").alias("price"), F.max("date").alias("price_date")
    )


def price_positions(
    positions: DataFrame, bars: DataFrame, as_of: date, max_age_days: int = 3
) -> DataFrame:
    """Lots with their current price, or the purchase price where no fresh close exists.

    Prices are one row per ticker. Spark broadcasts them when small; beyond that the join
    shuffles and AQE splits a ticker that holds many lots."""
    prices = latest_price(bars, as_of, max_age_days).select(
        F.col("symbol").alias("ticker"), F.col("price").alias("_p")
    )
    known = F.coalesce(F.col("_p"), F.col("purchase_price").cast("double"))
    return positions.join(prices, "ticker", "left").withColumn("current_price", known).drop("_p")


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def lot_profit(priced: DataFrame) -> DataFrame:
    """cost_basis, current_value, unrealized gain and percent per lot."""
    cost = _d("purchase_price") * _d("quantity")
    value = F.col("current_price") * _d("quantity")
    return priced.withColumns(
        {
            "cost_basis": cost,
            "current_value": value,
            "unrealized_pl": (F.col("current_price") - _d("purchase_price")) * _d("quantity"),
            "unrealized_pct": (F.col("current_price") / _d("purchase_price") - 1.0) * 100.0,
        }
    )


def portfolio_summary(priced: DataFrame) -> DataFrame:
    """One row: total value, invested, profit and percent (0 when nothing is invested)."""
    value = S.exact_sum(F.col("current_price") * _d("quantity"))
    invested = S.exact_sum(_d("purchase_price") * _d("quantity"))
    tot = priced.agg(F.coalesce(value, F.lit(0.0)).alias("total_value"),
                     F.coalesce(invested, F.lit(0.0)).alias("total_invested"))
    v, i = F.col("total_value"), F.col("total_invested")
    return tot.select(
        v,
        i,
        (v - i).alias("total_profit_loss"),
        F.when(i > 0, (v / i - 1.0) * 100.0).otherwise(F.lit(0.0)).alias("total_profit_loss_pct"),
    )


def by_ticker(priced: DataFrame) -> DataFrame:
    """Per ticker totals where each lot is rounded to whole units *before* summing, and the
    return follows from the rounded sums."""
    df = lot_profit(priced)
    sums = df.groupBy("ticker").agg(
        F.sum(S.js_round(_d("quantity"))).alias("total_quantity"),
        F.sum(S.js_round(F.col("cost_basis"))).alias("total_cost_basis"),
        F.sum(S.js_round(F.col("current_value"))).alias("total_current_value"),
        F.sum(S.js_round(F.col("current_value") - F.col("cost_basis"))).alias(
            "total_unrealized_gain"
        ),
    )
    pct = (S.ratio(F.col("total_current_value"), F.col("total_cost_basis")) - 1.0) * 100.0
    return sums.withColumn("return_pct", pct)


def weights(priced: DataFrame) -> DataFrame:
    """Share of each ticker in the total value. The total is a scalar subquery, so there is no
    one-partition window."""
    per = priced.groupBy("ticker").agg(
        S.exact_sum(_d("quantity")).alias("total_quantity"),
        S.exact_sum(F.col("current_price") * _d("quantity")).alias("total_value"),
    )
    total = priced.select(S.exact_sum(F.col("current_price") * _d("quantity"))).scalar()
    return per.withColumn("weight", F.col("total_value") / total)


def top_and_bottom(per_ticker: DataFrame, n: int = 5) -> DataFrame:
    """The n best and n worst tickers by return; each side is a take-ordered. ``place`` counts
    from the best, or from the worst, upward."""

    def side(order: Column, name: str) -> DataFrame:
        top = per_ticker.orderBy(order, "ticker").limit(n)
        return top.withColumn("side", F.lit(name))

    best = side(F.col("return_pct").desc(), "top")
    return best.unionByName(side(F.col("return_pct").asc(), "bottom"))


def realized_pl(transactions: DataFrame) -> DataFrame:
    """(selling price - price)·quantity - fees for all rows; a close price of 0 or NULL means
    the price itself."""
    sold = F.coalesce(S.zero_to_null(_d("close_price")), _d("price"))
    fees = F.coalesce(_d("fees"), F.lit(0.0))
    return transactions.withColumn("realized_pl", (sold - _d("price")) * _d("quantity") - fees)


def preview_close(lots: DataFrame, requests: DataFrame) -> DataFrame:
    """Estimated profit and remaining quantity per request, nothing applied; zero for
    non-positive inputs."""
    df = requests.join(
        lots.select(F.col("id").alias("position_id"), "ticker", "quantity", "purchase_price"),
        "position_id",
    )
    ok = (F.col("quantity_to_close") > 0) & (F.col("closing_price") > 0)
    q, close, buy = _d("quantity_to_close"), _d("closing_price"), _d("purchase_price")
    return df.withColumns(
        {
            "pl": F.when(ok, close * q - buy * q - _d("fees")).otherwise(F.lit(0.0)),
            "pl_pct": F.when(ok, (close / buy - 1.0) * 100.0).otherwise(F.lit(0.0)),
            "remaining": _d("quantity") - q,
        }
    )


def _request_folder():
    """A closure, so that Spark pickles it by value and executors need not have this package."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Requests of a lot in sequence: accepted when the quantity still covers it. Only the
        lot's id and remaining quantity are carried, so a lot may have any number of requests."""
        lot, left = None, None
        for pdf in batches:
            accepted = []
            for pid, want, have in zip(
                pdf["position_id"], pdf["quantity_to_close"], pdf["quantity"]
            ):
                if pid != lot:
                    lot, left = pid, have
                ok = want <= left
                if ok:
                    left = left - want
                accepted.append(ok)
            pdf["accepted"] = accepted
            yield pdf

    return fold


def apply_requests(lots: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request with its outcome: ``status`` is accepted, missing or over.

    Requests apply in ``seq`` order per lot and a refused one changes nothing, so a later smaller
    one may still pass. Settled by plain expressions: requests for unknown lots, those above the
    lot's full quantity (which can never pass), and all requests of a lot that together do not
    exceed it. Only the requests of overdrawn lots stream through a fold.
    """
    own = lots.select(F.col("id").alias("position_id"), "ticker", "quantity", "purchase_price")
    wanted = requests.groupBy("position_id").agg(F.sum("quantity_to_close").alias("_all"))
    joined = requests.join(own.join(wanted, "position_id"), "position_id", "left")
    status = (
        F.when(F.col("quantity").isNull(), F.lit("missing"))
        .when(F.col("quantity_to_close") > F.col("quantity"), F.lit("over"))
        .when(F.col("_all") <= F.col("quantity"), F.lit("accepted"))
    )
    told = joined.withColumn("status", status).drop("_all")
    settled = told.where(F.col("status").isNotNull())
    open_ = told.where(F.col("status").isNull()).drop("status")
    schema = T.StructType([*open_.schema.fields, T.StructField("accepted", T.BooleanType())])
    folded = (
        open_.repartition("position_id")
        .sortWithinPartitions("position_id", "seq")
        .mapInPandas(_request_folder(), schema)
        .withColumn("status", F.when(F.col("accepted"), F.lit("accepted")).otherwise(F.lit("over")))
        .drop("accepted")
    )
    done = folded.unionByName(settled)
    hit = F.col("status") == "accepted"
    q, close, buy = _d("quantity_to_close"), _d("closing_price"), _d("purchase_price")
    fees = F.coalesce(_d("fees"), F.lit(0.0))
    return done.withColumn(
        "realized_pl", F.when(hit, close * q - buy * q - fees)
    ).withColumn("realized_pl_pct", F.when(hit, (close / buy - 1.0) * 100.0))


def closing_transactions(applied: DataFrame) -> DataFrame:
    """The sell transactions the accepted requests produce."""
    # Fixed value: the text of a note that the request does not give.
    note = F.concat(
        F.lit("Position closure - Realized P/L: "), F.format_string("%.6f", F.col("realized_pl"))
    )
    return applied.where(F.col("status") == "accepted").select(
        F.col("seq").alias("id"),
        "ticker",
        F.lit("sell").alias("transaction_type"),
        F.col("quantity_to_close").alias("quantity"),
        F.col("purchase_price").alias("price"),
        F.col("closing_price").alias("close_price"),
        F.col("closing_date").alias("transaction_date"),
        F.coalesce(F.col("fees"), F.lit(0).cast(schemas.FEE)).alias("fees"),
        F.coalesce(F.nullif(F.col("notes"), F.lit("")), note).alias("notes"),
    )


def remaining_lots(lots: DataFrame, applied: DataFrame) -> DataFrame:
    """Lots reduced by what was closed; fully closed ones are gone."""
    closed = (
        applied.where(F.col("status") == "accepted")
        .groupBy("position_id")
        .agg(F.sum("quantity_to_close").cast(schemas.QTY).alias("_c"))
        .withColumnRenamed("position_id", "id")
    )
    left = (F.col("quantity") - F.coalesce(F.col("_c"), F.lit(0).cast(schemas.QTY))).cast(schemas.QTY)
    return lots.join(closed, "id", "left").withColumn("quantity", left).where(
        F.col("quantity") != 0
    ).select(*lots.columns)


def close_positions(lots: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new lots, sell transactions, rejected requests). Invalid requests count as rejected."""
    checked = tables.validate(requests, tables.request_checks())
    applied = apply_requests(lots, tables.valid_rows(checked))
    broken = tables.rejected_rows(checked).select(
        "seq", "position_id", F.array_join("reasons", ", ").alias("status")
    )
    refused = applied.where(F.col("status") != "accepted").select("seq", "position_id", "status")
    return remaining_lots(lots, applied), closing_transactions(applied), refused.unionByName(broken)


def constant_history(priced: DataFrame, start: date, end: date) -> DataFrame:
    """Each ticker at one constant price over the business days of a range; of several lots the
    one with the highest id counts."""
    per = priced.groupBy("ticker").agg(F.max_by("current_price", "id").alias("close"))
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    weekdays = F.filter(days, lambda d: F.weekday(d) < 5)
    return per.select(F.explode(weekdays).alias("date"), "ticker", "close")
