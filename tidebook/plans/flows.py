"""Whole paths put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.clock import kst_day
from tidebook.operators import ledger, replay, series
from tidebook.operators.orders import market_semi
from tidebook.sources import decode, files


def ledger_from_messages(orders: DataFrame, executions: DataFrame, position: str = "offset", known_markets: bool = True) -> DataFrame:
    """Order ledger straight from the JSON messages of both topics.

    `position` numbers the messages of a topic. Unreadable messages are skipped; with
    `known_markets` so are orders and executions of markets outside the dimension.
    """
    events = decode.order_rows(decode.decode_orders(orders), position)
    done = decode.execution_rows(decode.decode_executions(executions), F.lit(None).cast("timestamp"), position)
    if known_markets:
        events, done = market_semi(events), market_semi(done)
    return ledger.order_ledger(events, done, position, [position, "price", "quantity"])


def replay_plan(
    spark: SparkSession, root: str, day: str, speed: float, shard: tuple[int, int] = (0, 1), from_ts: int = 0, to_ts: int = 0
) -> DataFrame:
    """Submit schedule of one recorded KST day for one replay instance."""
    recorded = files.read_order_records(spark, root, day=day).withColumnRenamed("market", "market_code")
    chosen = series.range_filter(replay.shard_slice(recorded, *shard), from_ts, to_ts)
    start = int(kst_day(day)[0].timestamp() * 1000)
    # Records of a day are kept in time order; chunks follow the clock.
    return replay.schedule_by(chosen, speed, ["ts", "order_id"], F.floor((F.col("ts") - F.lit(start)) / 60_000))
