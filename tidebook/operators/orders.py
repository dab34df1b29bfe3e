"""Order validation, summaries and run-level figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.clock import iso, moment, within
from tidebook.functions.ticks import on_tick, wire_double, with_ticks
from tidebook.schemas import MODES, OPEN_STATUSES, SIDES, STATUSES, is_market, market_dim

# Pass line of a load run.
TPS_GOAL = 10_000
FILL_GOAL = 90


def default_mode(mode: Column) -> Column:
    """Unknown or missing modes count as paper trading."""
    return F.when(mode.isin(*MODES), mode).otherwise(F.lit(MODES[0]))


def validate_orders(orders: DataFrame) -> DataFrame:
    """Orders given as wire texts with `error_code`, the first failing rule or null."""
    parsed = orders.withColumns({"p": wire_double(F.col("price")), "q": wire_double(F.col("quantity"))})
    p, q = F.col("p"), F.col("q")
    code = (
        F.when(~is_market(F.col("market_code")), "INVALID_MARKET")
        .when(~F.coalesce(F.col("side").isin(*SIDES), F.lit(False)), "INVALID_SIDE")
        .when(p.isNull() | (p <= 0), "INVALID_PRICE")
        .when(~on_tick(F.col("ratio")), "INVALID_PRICE_UNIT")
        .when(q.isNull() | (q <= 0), "INVALID_QUANTITY")
    )
    return with_ticks(parsed, "p").withColumn("error_code", code).select(*orders.columns, "error_code")


def split_valid(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) orders."""
    checked = validate_orders(orders)
    accepted = checked.filter(F.col("error_code").isNull()).drop("error_code")
    return accepted, checked.filter(F.col("error_code").isNotNull())


def sanitize_decisions(decisions: DataFrame) -> DataFrame:
    """Trading decisions with a flag: unusable ones are skipped, the rest is kept."""
    usable = (
        (F.col("market_code") != "") & F.col("side").isin(*SIDES)
        & (F.col("price") > 0) & (F.col("quantity") > 0)
    )
    return decisions.withColumn("skipped", ~F.coalesce(usable, F.lit(False)))


def decision_counts(decisions: DataFrame) -> DataFrame:
    return sanitize_decisions(decisions).agg(
        F.count_if(~F.col("skipped")).alias("kept"), F.count_if("skipped").alias("skipped")
    )


def of_run(orders: DataFrame, mode: str | None, start, end, ts: str = "submitted_at") -> DataFrame:
    """Rows of one run: its mode and [start, end)."""
    test = within(F.col(ts), start, end)
    if mode is not None:
        test = test & (F.col("mode") == mode)
    return orders.filter(test)


def _status_counts() -> list[Column]:
    status = F.col("status")
    return [
        F.count(F.lit(1)).alias("accepted"),
        F.count_if(status == "FILLED").alias("filled"),
        F.count_if(status.isin(*OPEN_STATUSES)).alias("unfilled"),
    ]


def order_summary(orders: DataFrame, mode: str, start, end) -> DataFrame:
    return of_run(orders, mode, start, end).agg(*_status_counts())


def summary_by_market(orders: DataFrame, mode: str, start, end) -> DataFrame:
    return of_run(orders, mode, start, end).groupBy("market_code").agg(*_status_counts()).orderBy("market_code")


def summary_by_side(orders: DataFrame, mode: str, start, end) -> DataFrame:
    return (
        of_run(orders, mode, start, end).groupBy("side")
        .agg(F.count(F.lit(1)).alias("orders")).orderBy("side")
    )


def orders_by_status(orders: DataFrame, now, minutes: int = 10) -> DataFrame:
    """Counts of recently submitted orders; every status is present."""
    recent = orders.filter(
        (F.col("submitted_at") >= F.lit(moment(now)) - F.expr(f"interval {minutes} minutes"))
        & F.col("status").isin(*STATUSES)
    )
    zeros = orders.sparkSession.createDataFrame([(s, 0) for s in STATUSES], "status string, orders bigint")
    counted = recent.groupBy("status").agg(F.count(F.lit(1)).alias("orders"))
    return counted.unionByName(zeros).groupBy("status").agg(F.sum("orders").alias("orders"))


def all_unresolved(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status").isin(*OPEN_STATUSES)).select("order_id", "market_code")


def unresolved_orders(orders: DataFrame, mode: str, start, end) -> DataFrame:
    return all_unresolved(of_run(orders, mode, start, end))


def pending_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status").isin(*OPEN_STATUSES)).agg(F.count(F.lit(1)).alias("pending_orders"))


def cleanup_cancels(orders: DataFrame, now) -> DataFrame:
    """One CANCEL event for every order still open."""
    return all_unresolved(orders).select(
        F.lit("CANCEL").alias("type"),
        F.col("order_id").cast("string").alias("orderId"),
        F.col("market_code").alias("market"),
        iso(F.lit(moment(now))).alias("canceledAt"),
    )


def fill_share(orders: DataFrame, mode: str, start, end) -> DataFrame:
    """Per market: filled, unfilled, buy and sell percents, rounded half up, 0 when empty."""
    def percent(part, whole):
        return F.when(F.col(whole) > 0, F.floor(F.col(part) / F.col(whole) * 100 + 0.5)).otherwise(F.lit(0))

    counted = (
        of_run(orders, mode, start, end).groupBy("market_code")
        .agg(*_status_counts(), F.count_if(F.col("side") == "BUY").alias("buy"),
             F.count_if(F.col("side") == "SELL").alias("sell"))
        .withColumn("sided", F.col("buy") + F.col("sell"))
    )
    return counted.select(
        "market_code", "accepted", "filled",
        percent("filled", "accepted").alias("fill_percent"),
        percent("unfilled", "accepted").alias("unfilled_percent"),
        percent("buy", "sided").alias("buy_percent"),
        percent("sell", "sided").alias("sell_percent"),
    )


def run_verdict(orders: DataFrame, mode: str, start, end) -> DataFrame:
    """Average TPS (at least one second long), fill rate and pass/fail of one run."""
    seconds = max(1.0, (moment(end) - moment(start)).total_seconds())
    rated = order_summary(orders, mode, start, end).select(
        "accepted", "filled",
        (F.col("accepted") / F.lit(seconds)).alias("average_tps"),
        (F.col("filled") / F.greatest("accepted", F.lit(1)) * 100).alias("fill_rate"),
    )
    passed = (F.col("average_tps") >= TPS_GOAL) & (F.col("fill_rate") >= FILL_GOAL)
    return rated.withColumn("verdict", F.when(passed, "pass").otherwise("fail"))


def intake_outcomes(requests: DataFrame) -> DataFrame:
    return requests.groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"))


def market_semi(rows: DataFrame) -> DataFrame:
    """Drop rows whose market is not in the dimension (20 rows, so broadcast)."""
    dim = F.broadcast(market_dim(rows.sparkSession).select("market_code"))
    return rows.join(dim, "market_code", "left_semi")


def market_listing(orders: DataFrame) -> DataFrame:
    """The market dimension with the number of orders seen per market."""
    counted = orders.groupBy("market_code").agg(F.count(F.lit(1)).alias("orders"))
    return (
        market_dim(orders.sparkSession).join(counted, "market_code", "left")
        .select("market_index", "market_code", "korean_name", "symbol",
                F.coalesce("orders", F.lit(0)).alias("orders"))
    )
