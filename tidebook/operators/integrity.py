"""Checks of the ledger against its executions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.orders import of_run


def fills(executions: DataFrame, *extra: str) -> DataFrame:
    """One row per side and execution, from a single scan."""
    sides = F.explode(F.array(
        F.struct(F.col("buy_order_id").alias("order_id"), F.lit("BUY").alias("side")),
        F.struct(F.col("sell_order_id").alias("order_id"), F.lit("SELL").alias("side")),
    ))
    return executions.select(sides.alias("fill"), "quantity", *extra).select("fill.*", "quantity", *extra)


def overfilled_orders(orders: DataFrame, executions: DataFrame, mode=None, start=None, end=None) -> DataFrame:
    """Orders whose fills of the window add up to more than they asked for.

    Fills are summed per order before the join, so a much traded order crosses the shuffle
    as one partial sum per task.
    """
    filled = (
        fills(of_run(executions, mode, start, end, "executed_at"))
        .groupBy("order_id").agg(F.sum("quantity").alias("filled_quantity"))
    )
    return (
        orders.select("order_id", "quantity").join(filled, "order_id")
        .filter(F.col("filled_quantity") > F.col("quantity"))
    )


def overfilled(orders, executions, mode=None, start=None, end=None) -> DataFrame:
    return overfilled_orders(orders, executions, mode, start, end).agg(
        F.count(F.lit(1)).alias("duplicate_executions")
    )


def with_both_orders(executions: DataFrame, orders: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Executions with columns of their buy and sell order as buy_* and sell_*.

    Two equi joins on purpose: one join with an OR condition would compare all pairs.
    """
    for side in ("buy", "sell"):
        matched = orders.select(
            F.col("order_id").alias(f"{side}_order_id"),
            *[F.col(c).alias(f"{side}_{c}") for c in columns],
        )
        executions = executions.join(matched, f"{side}_order_id", how)
    return executions


def sequence_reversals(orders, executions, mode=None, start=None, end=None) -> DataFrame:
    """Executions stamped before one of their orders was submitted; unseen orders never count."""
    chosen = of_run(executions, mode, start, end, "executed_at").select(
        "buy_order_id", "sell_order_id", "executed_at"
    )
    paired = with_both_orders(chosen, orders, ["submitted_at"], "left")
    early = (F.col("executed_at") < F.col("buy_submitted_at")) | (F.col("executed_at") < F.col("sell_submitted_at"))
    return paired.agg(F.count_if(early).alias("sequence_reversals"))


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row results side by side, as an aggregate over their union."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def _run_totals(orders: DataFrame, mode, start, end) -> DataFrame:
    """Accepted orders and filled quantity per side, from one scan."""
    done = F.col("quantity") - F.col("remaining_quantity")

    def total(side):
        return F.coalesce(F.sum(F.when(F.col("side") == side, done)), F.lit(0).cast("decimal(34,8)"))

    return of_run(orders, mode, start, end).agg(
        F.count(F.lit(1)).alias("accepted"), total("BUY").alias("buy_filled"), total("SELL").alias("sell_filled")
    )


def _balanced():
    return F.abs(F.col("buy_filled") - F.col("sell_filled")) <= F.lit(1e-6)


def _loss():
    """Planned minus accepted orders, never negative; null without a plan."""
    return F.when(F.col("planned").isNotNull(), F.greatest(F.lit(0), F.col("planned") - F.col("accepted")))


def _planned(recorded: DataFrame | None, like: DataFrame) -> DataFrame:
    if recorded is None:
        return like.sparkSession.createDataFrame([(None,)], "planned bigint")
    return recorded.agg(F.count(F.lit(1)).alias("planned"))


def filled_totals(orders: DataFrame, mode=None, start=None, end=None) -> DataFrame:
    """Filled quantity of both sides; they agree up to 1e-6 in a sound ledger."""
    return _run_totals(orders, mode, start, end).drop("accepted").withColumn("balanced", _balanced())


def order_loss(orders: DataFrame, recorded: DataFrame | None, mode: str, start, end) -> DataFrame:
    """Orders of the plan (the recorded ones) that were not accepted; null without a plan."""
    accepted = of_run(orders, mode, start, end).agg(F.count(F.lit(1)).alias("accepted"))
    return one_row(accepted, _planned(recorded, orders)).withColumn("order_loss", _loss())


def integrity(orders, executions, mode=None, start=None, end=None, planned: DataFrame | None = None) -> DataFrame:
    """All checks in one row: independent aggregates of one plan, side by side."""
    checks = one_row(
        overfilled(orders, executions, mode, start, end),
        sequence_reversals(orders, executions, mode, start, end),
        _run_totals(orders, mode, start, end),
        _planned(planned, orders),
    )
    return checks.withColumns({"balanced": _balanced(), "order_loss": _loss()}).drop("accepted", "planned")
