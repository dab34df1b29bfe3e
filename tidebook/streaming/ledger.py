"""The order ledger as a stream, its state in a versioned table.

Each micro-batch reads the states of the orders it touches, merges its own, and commits them together with the
execution pairs it has seen. Nothing is held between batches but those tables.

With a retention, closed orders whose last change lies farther back than it, counted from the newest change,
move to a table of rows that are only added, and pairs as old are forgotten. Nothing is lost with that: a late
event makes a new partial state, which merges with the retired one when the ledger is read. Only an execution
delivered again later than the retention counts twice. States without their order stay until it comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.operators.integrity import fills
from tidebook.operators.ledger import ORDER_FIELDS, first_by, ledger_rows, merge_states, state_rows, state_status
from tidebook.session import small_tasks
from tidebook.sources.versions import Retirement, Table, VersionStore

PAIR = ["buy_order_id", "sell_order_id"]
TABLES = {"orders": Table(("order_id",)), "pairs": Table(tuple(PAIR)), "closed": Table()}


def ledger_store(spark: SparkSession, root: str, keep: int = 8) -> VersionStore:
    return VersionStore(spark, root, TABLES, keep)


def both_topics(events: DataFrame, executions: DataFrame, order: str = "offset") -> DataFrame:
    """Order events and executions (with executed_at) as one stream."""
    left = events.select("type", "order_id", "canceled_at", order, *ORDER_FIELDS)
    right = executions.select(*PAIR, F.col("quantity").alias("done"), "executed_at", F.col(order).alias("done_at"))
    return left.unionByName(right, allowMissingColumns=True)


def _retirement(retention: str | None):
    def retire(store: VersionStore) -> Retirement:
        newest = store.newest("orders").agg(F.max("changed") - F.expr(f"interval {retention}")).first()[0]
        if newest is None:
            return {}
        old = F.col("changed") < F.lit(newest)
        closed = F.col("o").isNotNull() & state_status().isin("FILLED", "CANCELED")
        return {"orders": (~(closed & old), "closed"), "pairs": (F.col("executed_at") >= F.lit(newest), None)}

    return retire if retention else None


def ledger_job(
    events: DataFrame, executions: DataFrame, root: str, checkpoint: str, order: str = "offset",
    retention: str | None = None, keep: int = 8,
):
    """Writer of the ledger stream; give it a trigger and start it.

    The stream takes its session's settings when it starts, those of small tasks among them.
    """
    small_tasks(events.sparkSession)
    retire = _retirement(retention)

    def step(batch: DataFrame, number: int) -> None:
        store = ledger_store(batch.sparkSession, root, keep)
        if store.committed(number):
            return
        done = batch.filter(F.col("done").isNotNull())
        pairs = first_by(done, PAIR, ["done_at", "executed_at", "done"]).select(*PAIR, "done", "executed_at")
        seen = store.newest("pairs", like=pairs, touched=pairs.select(PAIR[0]))
        fresh = pairs.join(seen.select(*PAIR), PAIR, "left_anti")
        filled = fills(fresh.withColumnsRenamed({"done": "quantity", "executed_at": "at"}), "at")
        states = state_rows(batch.filter(F.col("type").isNotNull()), filled, order)
        before = store.newest("orders", like=states, touched=states.select("order_id"))
        store.commit(number, {"orders": merge_states(before.unionByName(states)), "pairs": fresh}, retire)

    return both_topics(events, executions, order).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def current_ledger(store: VersionStore) -> DataFrame:
    """All orders of the stream, the retired ones with them."""
    small_tasks(store.spark)
    states = store.newest("orders")
    return ledger_rows(merge_states(states.unionByName(store.newest("closed", like=states))))


def start(writer, drain: bool, interval: str) -> StreamingQuery:
    """At a steady interval, or one pass over all data present."""
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)).start()
