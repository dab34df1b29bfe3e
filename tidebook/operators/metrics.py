"""Rates, latency, time-bucketed series and metric samples."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.clock import bucket, bucket_label, kst_hour, moment, within
from tidebook.operators.integrity import one_row, with_both_orders
from tidebook.operators.orders import pending_orders
from tidebook.operators.ordered import Slices, previous

# Rolling windows, series bounds and bucket widths (span limit s, width s).
TPS_SECONDS = 60
LATENCY_MINUTES = 5
MAX_SPAN = timedelta(hours=24)
BUCKET_WIDTHS = ((30 * 60, 60), (3 * 3600, 300), (12 * 3600, 900))
WIDEST_BUCKET = 1800
RESTARTS_SHOWN = 20


# ---- rates and latency -------------------------------------------------------------------

def _window(now, run, **back):
    """[start, end) of a finished run, or a rolling window that ends at `now`."""
    if run is not None:
        return moment(run[0]), moment(run[1])
    return moment(now) - timedelta(**back), None


def tps(orders: DataFrame, executions: DataFrame, now=None, run=None) -> DataFrame:
    """Accept and execution rate of the last 60 s, or averaged over a finished run."""
    start, end = _window(now, run, seconds=TPS_SECONDS)
    seconds = float(TPS_SECONDS)
    if run is not None:
        seconds = (end - start).total_seconds()
        seconds = seconds if seconds > 0 else 1.0

    def rate(rows, ts, name):
        return rows.filter(within(F.col(ts), start, end)).agg((F.count(F.lit(1)) / F.lit(seconds)).alias(name))

    return one_row(rate(orders, "submitted_at", "accept_tps"), rate(executions, "executed_at", "execution_tps"))


def taker_latency(orders, executions, now=None, run=None) -> DataFrame:
    """Milliseconds from the later of the two submissions to the execution."""
    start, end = _window(now, run, minutes=LATENCY_MINUTES)
    chosen = executions.filter(within(F.col("executed_at"), start, end)).select(
        "buy_order_id", "sell_order_id", "executed_at"
    )
    paired = with_both_orders(chosen, orders, ["submitted_at"], "inner")
    taker = F.greatest("buy_submitted_at", "sell_submitted_at")
    micros = F.unix_micros("executed_at") - F.unix_micros(taker)
    return paired.select(micros.alias("micros"))


def value_at_rank(values: DataFrame, column: str, share: float) -> DataFrame:
    """Exact value at rank max(floor(share * n), 1), with the sample count; 0 for no samples.

    The values are counted into a histogram, which stays distributed. The rank is then
    narrowed down in three steps of at most 2^20 groups, so no task ever sees more than the
    counters of one step.
    """
    v = F.col(column)
    histogram = values.filter(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    # Never-null level columns keep the joins below from adding null filters of their own, so
    # all three levels read one shuffled histogram.
    histogram = histogram.withColumns(
        {name: F.coalesce(F.shiftright("v", bits), F.lit(0)) for name, bits in (("high", 40), ("mid", 20))}
    )

    def holding_rank(groups, level):
        """The one group that holds the rank, and the rank counted from its start."""
        placed = groups.withColumn("upto", F.sum("c").over(Window.orderBy(level)))
        hit = placed.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        return hit.select(level, "n", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))

    coarse = histogram.groupBy("high").agg(F.sum("c").alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy()))
    coarse = coarse.withColumn("rank", F.greatest(F.floor(F.col("n") * share), F.lit(1)))
    high = F.broadcast(holding_rank(coarse, "high"))  # one row
    finer = histogram.join(high, "high").groupBy("mid", "n", "rank").agg(F.sum("c").alias("c"))
    mid = F.broadcast(holding_rank(finer, "mid"))  # one row
    exact = holding_rank(histogram.join(mid, "mid"), "v")
    return exact.agg(
        F.coalesce(F.max("v"), F.lit(0)).alias("value"), F.coalesce(F.max("n"), F.lit(0)).alias("samples")
    )


def latency_p99(orders, executions, now=None, run=None) -> DataFrame:
    ranked = value_at_rank(taker_latency(orders, executions, now, run), "micros", 0.99)
    return ranked.select((F.col("value") / 1000.0).alias("p99_ms"), F.col("samples").alias("sample_count"))


def dashboard(orders, executions, assignments, now=None, run=None) -> DataFrame:
    """The live figures in one row."""
    open_engines = assignments.filter(F.col("released_at").isNull()).agg(
        F.countDistinct("engine_instance_id").alias("running_engines")
    )
    source = F.lit("last_run" if run is not None else "realtime")
    return one_row(
        tps(orders, executions, now, run), pending_orders(orders),
        latency_p99(orders, executions, now, run), open_engines,
    ).withColumn("window_source", source)


# ---- series ------------------------------------------------------------------------------

def bucket_width(span: timedelta) -> int:
    for limit, width in BUCKET_WIDTHS:
        if span.total_seconds() <= limit:
            return width
    return WIDEST_BUCKET


def check_span(start, end) -> timedelta:
    span = moment(end) - moment(start)
    if span <= timedelta(0):
        raise ValueError("the series must start before it ends")
    if span > MAX_SPAN:
        raise ValueError(f"the series may span at most {MAX_SPAN}")
    return span


def _zero_buckets(spark, first: int, last: int, width: int, names: list[str]) -> DataFrame:
    """Zero rows for all buckets first..last, both included."""
    return spark.range(first, last + 1, width, 1).select(
        F.col("id").alias("bucket"), *[F.lit(0).cast("bigint").alias(n) for n in names]
    )


def _counted(rows: DataFrame, ts: str, width: int, name: str) -> DataFrame:
    return rows.groupBy(bucket(F.col(ts), width).alias("bucket")).agg(F.count(F.lit(1)).alias(name))


def _series(parts: list[DataFrame], names: list[str]) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    summed = merged.groupBy("bucket").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return summed.select(bucket_label(F.col("bucket")).alias("bucket_start"), *names)


def _floor_seconds(value) -> int:
    return int(moment(value).timestamp() // 1)


def _range_parts(orders, executions, start, end, width) -> list[DataFrame]:
    first = _floor_seconds(start) // width * width
    whole_end = _floor_seconds(end)
    # The series ends with the last bucket that starts before the whole end second.
    last = (whole_end - 1) // width * width
    zeros = _zero_buckets(orders.sparkSession, first, last, width, ["orders", "executions"])

    def part(rows, ts, name):
        return _counted(rows.filter(within(F.col(ts), start, end)), ts, width, name).filter(F.col("bucket") <= last)

    return [zeros, part(orders, "submitted_at", "orders"), part(executions, "executed_at", "executions")]


def throughput_series(orders: DataFrame, executions: DataFrame, start, end) -> DataFrame:
    """Orders and executions of [start, end) per bucket; the width follows the span."""
    width = bucket_width(check_span(start, end))
    return _series(_range_parts(orders, executions, start, end, width), ["orders", "executions"])


def throughput_with_dropped(orders, executions, dropped, start, end) -> DataFrame:
    """The throughput series with rejected orders counted at the same bucket width."""
    width = bucket_width(check_span(start, end))
    parts = _range_parts(orders, executions, start, end, width)
    last = (_floor_seconds(end) - 1) // width * width
    lost = _counted(dropped.filter(within(F.col("ts"), start, end)), "ts", width, "dropped")
    return _series([*parts, lost.filter(F.col("bucket") <= last)], ["orders", "executions", "dropped"])


def minute_series(orders: DataFrame, executions: DataFrame, now, minutes: int = 10) -> DataFrame:
    """Per-minute counts of the last `minutes` minutes, the current one included."""
    last = _floor_seconds(now) // 60 * 60
    first = last - (minutes - 1) * 60
    since = moment(now) - timedelta(minutes=minutes)

    def part(rows, ts, name):
        counted = _counted(rows.filter(F.col(ts) >= F.lit(since)), ts, 60, name)
        return counted.filter(F.col("bucket").between(first, last))

    zeros = _zero_buckets(orders.sparkSession, first, last, 60, ["orders", "executions"])
    return _series([zeros, part(orders, "submitted_at", "orders"), part(executions, "executed_at", "executions")],
                   ["orders", "executions"])


def dropped_series(dropped: DataFrame, start, end) -> DataFrame:
    """Rejected orders per minute; the bucket of `end` is part of the series."""
    check_span(start, end)
    first, last = _floor_seconds(start) // 60 * 60, _floor_seconds(end) // 60 * 60
    chosen = dropped.filter(
        (F.col("ts") >= F.timestamp_seconds(F.lit(first))) & (F.col("ts") < F.timestamp_seconds(F.lit(last + 60)))
    )
    zeros = _zero_buckets(dropped.sparkSession, first, last, 60, ["dropped"])
    return _series([zeros, _counted(chosen, "ts", 60, "dropped")], ["dropped"])


# ---- metric samples ----------------------------------------------------------------------

def latest_per_series(samples: DataFrame, keys: list[str], order: str = "ts") -> DataFrame:
    """Newest value of every series; the map-side aggregation keeps one row per series."""
    return samples.groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def metric_rollup(samples: DataFrame, series: list[str], by: str, order: str = "ts", matching: Column | None = None) -> DataFrame:
    """Sum and count of the newest samples by label, after a label filter."""
    chosen = samples if matching is None else samples.filter(matching)
    return latest_per_series(chosen, series, order).groupBy(by).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("series")
    )


def restarts_top(samples: DataFrame, series: list[str], by: str, order: str = "ts", limit: int = RESTARTS_SHOWN) -> DataFrame:
    """Highest restart counts first, zero ones left out."""
    rolled = metric_rollup(samples, series, by, order).filter(F.col("total") > 0)
    return (
        rolled.select(by, F.floor("total").alias("restarts"))
        .orderBy(F.desc("restarts"), by).limit(limit)
    )


def counter_rate(
    samples: DataFrame, series: list[str], order: list[str], window_seconds: int = 60, slice_seconds: int = 600
) -> DataFrame:
    """Per-second rate over all replicas per window; a falling counter restarted from zero."""
    steps = previous(samples, series, order, Slices("ts", slice_seconds), {"before": F.col("value")})
    rise = F.when(F.col("value") >= F.col("before"), F.col("value") - F.col("before")).otherwise(F.col("value"))
    counted = steps.filter(F.col("before").isNotNull()).groupBy(bucket(F.col("ts"), window_seconds).alias("bucket"))
    return counted.agg((F.sum(rise) / F.lit(float(window_seconds))).alias("rate")).select(
        bucket_label(F.col("bucket")).alias("bucket_start"), "rate"
    )


def resource_hourly(samples: DataFrame, sample_seconds: int = 300) -> DataFrame:
    """Replica sums per sampling step, then their average and peak per workload and KST hour.

    A pod counts once in a step, with its newest sample (the larger one of two at the same instant).
    """
    step = F.timestamp_seconds(bucket(F.col("ts"), sample_seconds))
    newest = samples.groupBy("workload", "pod", step.alias("step")).agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
    summed = newest.groupBy("workload", "step").agg(F.sum("value").alias("total"))
    return summed.groupBy("workload", kst_hour(F.col("step")).alias("hour_kst")).agg(
        F.avg("total").alias("total_avg"), F.max("total").alias("total_max")
    )


def consumer_lag(samples: DataFrame) -> DataFrame:
    """Lag per reader and poll: the positive parts of latest minus committed offsets."""
    behind = F.greatest(F.col("latest_offset") - F.col("committed_offset"), F.lit(0))
    return samples.groupBy("reader", "ts").agg(F.sum(behind).alias("lag"))


# ---- reconciliation ----------------------------------------------------------------------

def reconcile(by: list[str], left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Row counts of two tables per key and their difference, from one aggregation."""
    def tagged(rows, l, r):
        return rows.select(*by, F.lit(l).alias("l"), F.lit(r).alias("r"))

    both = tagged(left, 1, 0).unionByName(tagged(right, 0, 1))
    return both.groupBy(*by).agg(F.sum("l").alias(left_name), F.sum("r").alias(right_name)).withColumn(
        "difference", F.col(left_name) - F.col(right_name)
    )


def replay_rate_error(accepted: DataFrame, scheduled: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Accepted against scheduled orders per second; both sides carry unix `second`."""
    joined = reconcile(["second"], accepted, scheduled, "accepted", "scheduled").filter(F.col("scheduled") > 0)
    error = F.abs(F.col("difference")) / F.col("scheduled")
    return joined.select("second", "accepted", "scheduled", error.alias("error"), (error <= tolerance).alias("within_target"))
