"""Replays of recorded orders: previews, schedules, lineage, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.clock import moment
from tidebook.operators.integrity import one_row
from tidebook.operators.ordered import Running, number_chunk, scan
from tidebook.operators.orders import of_run
from tidebook.schemas import MARKET_CODES, market_index


def shard_slice(rows: DataFrame, shard_index: int, shard_count: int) -> DataFrame:
    """Rows of the markets that one replay instance owns."""
    return rows.filter(market_index(F.col("market_code")) % shard_count == shard_index)


def with_shard(rows: DataFrame, shard_count: int) -> DataFrame:
    return rows.withColumn("shard", market_index(F.col("market_code")) % shard_count)


def replay_preview(recorded: DataFrame, markets_total: int = len(MARKET_CODES)) -> DataFrame:
    """Size of a replay: orders, markets with records and the longest span in seconds."""
    per_market = recorded.groupBy("market_code").agg(
        F.count(F.lit(1)).alias("orders"), (F.max("ts") - F.min("ts")).alias("span_ms")
    )
    return per_market.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        F.count(F.lit(1)).alias("markets_with_records"),
        F.lit(markets_total).cast("bigint").alias("markets_total"),
        F.coalesce(F.max("span_ms") / 1000, F.lit(0.0)).alias("max_event_span_seconds"),
    )


def schedule_by(recorded: DataFrame, speed: float, order: list[str], chunk: Column) -> DataFrame:
    """Planned submit time of every recorded order, in seconds after the start of its market.

    A gap waits gap/speed; a record older than its predecessor does not wait, so the plan is a
    running sum and not a plain difference. `chunk` must never fall while `order` rises.
    """
    planned = scan(recorded, order, chunk, [Running("waited_ms", "climb", F.col("ts"), ("market_code",))])
    return planned.withColumn("planned_seconds", F.col("waited_ms") / 1000 / F.lit(float(speed))).drop("waited_ms")


def replay_schedule(recorded: DataFrame, speed: float, position: str = "position", chunk_rows: int = 1 << 20) -> DataFrame:
    """Schedule of records replayed in file order, `position` being the place in the file."""
    return schedule_by(recorded, speed, [position], number_chunk(F.col(position), chunk_rows))


def replay_duration(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy("market_code").agg(F.max("planned_seconds").alias("duration_seconds"))


def replay_lineage(orders: DataFrame) -> DataFrame:
    """Per market: replayed orders, how many sources are missing, and both market ratios.

    A replay keeps the share of each market when both ratios agree.
    """
    replays = orders.filter(F.col("mode") == "REPLAY").select("market_code", "source_order_id")
    sources = orders.filter(F.col("mode") != "REPLAY").select(
        F.col("order_id").alias("source_order_id"), F.col("market_code").alias("source_market")
    )
    # One row per source keeps the join side small where a source is replayed many times.
    counted = replays.groupBy("market_code", "source_order_id").agg(F.count(F.lit(1)).alias("replayed"))
    matched = counted.join(sources, "source_order_id", "left")
    missing = F.when(F.col("source_market").isNull(), F.col("replayed")).otherwise(0)
    same = F.when(F.col("source_market") == F.col("market_code"), F.col("replayed")).otherwise(0)
    per_replay = matched.groupBy("market_code").agg(
        F.sum("replayed").alias("replayed"), F.sum(missing).alias("missing"), F.sum(same).alias("same_market")
    )
    per_source = sources.groupBy(F.col("source_market").alias("market_code")).agg(F.count(F.lit(1)).alias("sources"))
    merged = per_replay.unionByName(per_source, allowMissingColumns=True).groupBy("market_code").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("replayed", "missing", "same_market", "sources")]
    )
    everything = Window.partitionBy()  # one row per market by now

    def ratio(name):
        total = F.sum(name).over(everything)
        return F.when(total > 0, F.col(name) / total).otherwise(0.0)

    return merged.withColumns({"replay_ratio": ratio("replayed"), "source_ratio": ratio("sources")})


def replay_progress(orders: DataFrame, recorded: DataFrame, mode: str, start, now, speed: float) -> DataFrame:
    """Percent done by count and by time, both within 0..100."""
    accepted = of_run(orders, mode, start, now).agg(F.count(F.lit(1)).alias("accepted"))
    both = one_row(accepted, replay_preview(recorded))
    elapsed = (moment(now) - moment(start)).total_seconds()
    total_seconds = F.col("max_event_span_seconds") / F.lit(float(speed))

    def percent(part: Column, whole: Column) -> Column:
        value = F.floor(F.least(part / whole * 100, F.lit(1e9)) + 0.5)
        return F.when(whole > 0, F.greatest(F.lit(0), F.least(F.lit(100), value))).otherwise(F.lit(0))

    return both.select(
        "accepted", "total_orders",
        percent(F.col("accepted"), F.col("total_orders")).alias("count_percent"),
        percent(F.lit(elapsed), total_seconds).alias("time_percent"),
    )
