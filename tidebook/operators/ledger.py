"""The order ledger: folding events, deduplication, assignments, idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.idempotency import accepted_requests  # noqa: F401
from tidebook.operators.integrity import fills, with_both_orders
from tidebook.operators.ordered import SLICE_ROWS, Running, Slices, number_chunk, running, scan
from tidebook.schemas import MODES, SIDES, is_market
from tidebook.session import cut

ORDER_FIELDS = (
    "market_code", "side", "price", "quantity", "mode", "submitted_at", "client_request_id", "source_order_id",
)


# ---- executions --------------------------------------------------------------------------

def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key.

    The rank limit is applied in the map task as well, so copies collapse before the shuffle.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", first).filter(F.col("__rank") == 1).drop("__rank")


def unseen(rows: DataFrame, stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet; `batch` holds the keys of all rows.

    The stored table is first cut down to the keys of the batch. Where the batch is small
    enough for Spark to broadcast it, the stored table is scanned but never shuffled.
    """
    hits = stored.select(*keys).join(batch.select(*keys), keys, "left_semi")
    return rows.join(hits, keys, "left_anti")


def dedup_executions(executions: DataFrame, order: list[str], stored: DataFrame | None = None) -> DataFrame:
    """Executions not stored yet, one per (buy, sell) pair."""
    pair = ["buy_order_id", "sell_order_id"]
    fresh = first_by(executions, pair, order)
    return fresh if stored is None else unseen(fresh, stored, executions, pair)


def resolve_mode(executions: DataFrame, orders: DataFrame) -> DataFrame:
    """Mode of each execution: that of the buy order, else of the sell order, else null."""
    paired = with_both_orders(executions, orders, ["mode"], "left")
    buy, sell = F.col("buy_mode"), F.col("sell_mode")
    return paired.select(
        *[F.col(c) for c in executions.columns if c != "mode"],
        F.coalesce(buy, sell).alias("mode"), buy.isNotNull().alias("buy_found"),
        sell.isNotNull().alias("sell_found"), F.coalesce(buy != sell, F.lit(False)).alias("mode_mismatched"),
    )


# ---- ledger fold -------------------------------------------------------------------------

def order_status(quantity: Column, filled: Column, canceled_at: Column) -> Column:
    return (
        F.when(quantity - filled <= 0, "FILLED").when(canceled_at.isNotNull(), "CANCELED")
        .when(filled > 0, "PARTIALLY_FILLED").otherwise("ACCEPTED")
    )


def state_rows(events: DataFrame, filled: DataFrame, order: str = "offset") -> DataFrame:
    """A partial order state for each NEW or CANCEL event and fill row (order_id, quantity, and at if it is known)."""
    is_new, is_cancel = F.col("type") == "NEW", F.col("type") == "CANCEL"
    fresh = F.struct(F.col(order).alias("opened"), *ORDER_FIELDS)
    stated = events.select(
        "order_id",
        F.when(is_new, fresh).alias("o"), F.when(is_new, F.col(order)).alias("new_at"),
        F.when(is_cancel, F.col("canceled_at")).alias("canceled"), F.when(is_cancel, F.col(order)).alias("cancel_at"),
        F.coalesce("canceled_at", "submitted_at").alias("changed"),
    )
    at = F.col("at") if "at" in filled.columns else F.lit(None).cast("timestamp")
    done = filled.select("order_id", F.col("quantity").cast("decimal(34,8)").alias("filled"), at.alias("changed"))
    return stated.unionByName(done, allowMissingColumns=True)


def merge_states(states: DataFrame) -> DataFrame:
    """States of the same orders in one; sums and first values merge in any order of arrival.

    One aggregation keyed by order. The first NEW and the first CANCEL count.
    """
    return states.groupBy("order_id").agg(
        F.min_by("o", "new_at").alias("o"), F.min("new_at").alias("new_at"),
        F.min_by("canceled", "cancel_at").alias("canceled"), F.min("cancel_at").alias("cancel_at"),
        F.coalesce(F.sum("filled"), F.lit(0)).cast("decimal(34,8)").alias("filled"), F.max("changed").alias("changed"),
    )


def state_status() -> Column:
    """Status of an order state."""
    return order_status(F.col("o.quantity"), F.col("filled"), F.col("canceled"))


def ledger_rows(states: DataFrame) -> DataFrame:
    """Order rows of merged states; a state without its order is none yet."""
    status = state_status()
    return states.filter(F.col("o").isNotNull()).select(
        "order_id", *[F.col(f"o.{c}") for c in ORDER_FIELDS],
        (F.col("o.quantity") - F.col("filled")).cast("decimal(34,8)").alias("remaining_quantity"),
        status.alias("status"),
        F.when(status != "FILLED", F.col("canceled")).alias("canceled_at"), F.col("o.opened").alias("opened"),
    )


def fold(events: DataFrame, filled: DataFrame, order: str = "offset") -> DataFrame:
    """Order state from NEW and CANCEL events and fill rows (order_id, quantity), whatever their order of arrival."""
    return ledger_rows(merge_states(state_rows(events, filled, order)))


def order_ledger(events: DataFrame, executions: DataFrame, order: str = "offset", execution_order: list[str] = ("offset",)) -> DataFrame:
    """The ledger as rows of orders, whatever the arrival order across the topics."""
    # Summing the fills on their own first is a pure hash aggregation; the fold then meets one
    # row per traded order.
    once = fills(dedup_executions(executions, list(execution_order)))
    return fold(events, once.groupBy("order_id").agg(F.sum("quantity").alias("quantity")), order)


# ---- order intake ------------------------------------------------------------------------

def insert_orders(
    batch: DataFrame, stored: DataFrame, order: str = "offset", markets: DataFrame | None = None,
    any_market: bool = False, stored_requests: DataFrame | None = None,
) -> DataFrame:
    """Rows of `batch` that a unique order id and a unique client request id let in.

    The accept path writes order id and client request id together, so copies of an order
    carry the same request id; keeping the first row per order and then per request is the
    outcome of inserting row by row. Rows breaking the table's checks are skipped, and so are
    those of markets outside the dimension, or outside `markets` (market_code) if given; `any_market`
    leaves that check out. `stored_requests` holds the stored request ids if `stored` holds order ids only.
    """
    valid = batch.filter(
        F.col("order_id").isNotNull() & F.col("market_code").isNotNull()
        & F.col("side").isin(*SIDES) & F.col("mode").isin(*MODES)
        & F.col("price").isNotNull() & F.col("quantity").isNotNull() & F.col("submitted_at").isNotNull()
    )
    if markets is not None:
        valid = valid.join(markets.select("market_code").distinct(), "market_code", "left_semi").select(*batch.columns)
    elif not any_market:
        valid = valid.filter(is_market(F.col("market_code")))
    per_order = first_by(valid, ["order_id"], [order])
    # Requests without an id never collide.
    keyed = first_by(per_order.filter(F.col("client_request_id").isNotNull()), ["client_request_id"], [order])
    unkeyed = per_order.filter(F.col("client_request_id").isNull())
    fresh = unseen(keyed.unionByName(unkeyed), stored, batch, ["order_id"])
    return unseen(fresh, stored if stored_requests is None else stored_requests, batch, ["client_request_id"]).select(*batch.columns)


def offset_dedup(events: DataFrame, arrival: str, chunk_rows: int = 1 << 20) -> DataFrame:
    """Events whose offset lies above every offset delivered before for the market."""
    seen = running(
        events, ["market_code"], [arrival], number_chunk(F.col(arrival), chunk_rows),
        {"applied": ("max", F.col("offset"))}, include_current=False,
    )
    return seen.filter(F.col("applied").isNull() | (F.col("offset") > F.col("applied"))).drop("applied")


# ---- lookups -----------------------------------------------------------------------------

def trace_orders(orders: DataFrame, executions: DataFrame, order_id=None) -> DataFrame:
    """Orders with their executions of either side, one row per execution.

    Long form on purpose: an order may own any number of executions.
    """
    if order_id is not None:
        orders = orders.filter(F.col("order_id") == order_id)
        executions = executions.filter((F.col("buy_order_id") == order_id) | (F.col("sell_order_id") == order_id))
    either = F.explode(F.array_distinct(F.array("buy_order_id", "sell_order_id")))
    touched = executions.select(
        either.alias("order_id"), "buy_order_id", "sell_order_id", "executed_at",
        F.col("quantity").alias("executed_quantity"),
    )
    # An inner join with the executions on the left can be split at a hot order; a left join
    # that keeps the orders cannot. Orders without executions are added back.
    met = touched.join(orders, "order_id").select(*orders.columns, *[c for c in touched.columns if c != "order_id"])
    alone = orders.join(touched.select("order_id").distinct(), "order_id", "left_anti").select(orders.columns)
    traced = met.unionByName(alone, allowMissingColumns=True)
    return traced.orderBy("order_id", "executed_at") if order_id is not None else traced


def cancel_outcomes(
    cancels: DataFrame, orders: DataFrame, executions: DataFrame, slice_seconds: int = 30 * 86400, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Answer to every cancel request (order_id, cancel_id, canceled_at).

    Fills and cancels of an order are walked in time order; a fill at the same instant
    counts before the cancel. Only fills of orders with a cancel are walked, summed per instant, and each
    knows whether its order's first cancel comes later: what an order's first cancel leaves is what all
    later ones are answered with, so one walk gives both. As fills only add up, a first cancel that finds
    the order filled is followed by none that does not.
    """
    at = F.struct("canceled_at", "cancel_id")
    first = cancels.groupBy("order_id").agg(
        F.min("canceled_at").alias("first_at"), F.min_by("cancel_id", at).alias("first_id")
    )
    done = fills(executions, "executed_at").select(
        "order_id", F.col("executed_at").alias("at"), F.col("quantity").alias("done")
    )
    early = F.when(F.col("at") <= F.col("first_at"), F.col("done"))
    done = done.join(first.select("order_id", "first_at"), "order_id").groupBy("order_id", "at").agg(
        F.sum("done").alias("done"), F.sum(early).alias("early")
    ).withColumn("asks", F.lit(0))
    asked = cancels.select("order_id", F.col("canceled_at").alias("at"), F.lit(1).alias("asks"), "cancel_id")
    # The walk is read twice; it is written once.
    walk = cut(asked.unionByName(done, allowMissingColumns=True), cancels.sparkSession)
    walked = running(
        walk, ["order_id"], ["at", "asks", "cancel_id"], Slices("at", slice_seconds, slice_rows),
        {"filled": ("sum", F.col("done")), "early_filled": ("sum", F.col("early"))},
    ).filter(F.col("asks") == 1)
    of_order = first.select("order_id", "first_id").join(orders.select("order_id", F.col("quantity").alias("ordered")), "order_id", "left")
    placed = walked.join(of_order, "order_id")

    def left(filled):
        return (F.col("ordered") - F.coalesce(filled, F.lit(0))).cast("decimal(34,8)")

    open_still = left("filled") > 0
    outcome = (
        F.when(F.col("ordered").isNull(), "ORDER_NOT_FOUND").when(~open_still, "ORDER_ALREADY_FILLED")
        .when(F.col("cancel_id") == F.col("first_id"), "CANCELED").otherwise("ALREADY_CANCELED")
    )
    return placed.select(
        "order_id", "cancel_id", outcome.alias("outcome"), F.when(open_still, left("early_filled")).alias("canceled_quantity"),
    )


# ---- engine assignments ------------------------------------------------------------------

def assignment_intervals(events: DataFrame, order: str = "offset", chunk_rows: int = 1 << 20) -> DataFrame:
    """Ownership intervals per market from ASSIGNED and RELEASED events in `order`.

    An interval ends with the next ASSIGNED of its market or the next RELEASED of its own
    engine, whichever arrives first; an open one has no end. Repeated ASSIGNED events are
    dropped first.
    """
    assigned = F.col("type") == "ASSIGNED"
    # Copies of an ASSIGNED event fall together, RELEASED events each stay a row.
    natural = ["type", "market_code", "engine_instance_id", "at"]
    each = F.when(F.col("type") == "RELEASED", F.col(order))
    known = events.filter(F.col("type").isin("ASSIGNED", "RELEASED"))
    rows = known.groupBy(*natural, each.alias("__each")).agg(F.min(order).alias(order)).drop("__each")

    def following(name, kind, *keys):
        value = F.when(F.col("type") == kind, F.struct(F.col(order).alias("seq"), "at"))
        return Running(name, "last", value, keys, include_current=False, backward=True)

    rows = scan(rows, [order], number_chunk(F.col(order), chunk_rows), [
        following("taken", "ASSIGNED", "market_code"), following("given", "RELEASED", "market_code", "engine_instance_id"),
    ])
    own_first = F.col("taken").isNull() | (F.col("given.seq") < F.col("taken.seq"))
    return rows.filter(assigned).select(
        "market_code", "engine_instance_id", F.col("at").alias("assigned_at"),
        F.when(F.col("given").isNotNull() & own_first, F.col("given.at")).otherwise(F.col("taken.at")).alias("released_at"),
    )


def engines(assignments: DataFrame) -> DataFrame:
    """Open assignments per engine; the market list is bounded by the market dimension."""
    held = (
        assignments.filter(F.col("released_at").isNull()).groupBy("engine_instance_id", "market_code")
        .agg(F.max("assigned_at").alias("assigned_at"))
    )
    listed = F.sort_array(F.collect_list(F.struct("market_code", "assigned_at")))
    return held.groupBy("engine_instance_id").agg(listed.alias("markets")).orderBy("engine_instance_id")
