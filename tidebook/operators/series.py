"""Tick and sample series: candles, histories, lags, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.clock import bucket, kst_date, kst_day, within
from tidebook.functions.ticks import quantity_text, with_price_text
from tidebook.operators.ordered import SLICE_ROWS, Slices, previous, running

# Price history length, quote spread and size, quote interval.
HISTORY = 30
QUOTE_SPREAD = 0.002
QUOTE_QUANTITY = 0.01
QUOTE_SECONDS = 2
LATEST_EVENTS = 50
TRADES_DEFAULT, TRADES_MAX = 50, 200

CANDLE_UNITS = ("second", "minute", "day", "week", "month", "year")


def map_side(ask_bid: Column) -> Column:
    return F.when(ask_bid == "BID", "BUY").when(ask_bid == "ASK", "SELL").otherwise(ask_bid)


def candle_start(ts: Column, unit: str) -> Column:
    """Start of the candle in unix seconds; days and longer units follow UTC."""
    if unit in ("second", "minute"):
        return bucket(ts, {"second": 1, "minute": 60}[unit])
    return F.unix_seconds(F.date_trunc(unit, ts))


def ohlcv(ticks: DataFrame, unit: str, tie: str = "sequential_id") -> DataFrame:
    """Candles per market: first/last price by (ts, tie), extremes and summed volume.

    All five figures merge map-side, so a busy market shuffles one row per candle and task.
    """
    at = F.struct("ts", tie)
    grouped = ticks.groupBy("market_code", candle_start(F.col("ts"), unit).alias("start"))
    return grouped.agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
    )


def rollup_candles(candles: DataFrame, unit: str) -> DataFrame:
    """Coarser candles from finer ones (days from minutes, years from days)."""
    start = candle_start(F.timestamp_seconds("start"), unit).alias("coarse")
    return (
        candles.groupBy("market_code", start)
        .agg(F.min_by("open", "start").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
             F.max_by("close", "start").alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("coarse", "start")
    )


def all_candles(ticks: DataFrame, tie: str = "sequential_id") -> dict[str, DataFrame]:
    """Candles of every unit, each from the next finer one instead of from the ticks again."""
    out = {"second": ohlcv(ticks, "second", tie)}
    for unit, finer in (("minute", "second"), ("day", "minute"), ("week", "day"), ("month", "day"), ("year", "day")):
        out[unit] = rollup_candles(out[finer], unit)
    return out


def build_stream(seconds: DataFrame, minutes: DataFrame, ticks: DataFrame) -> DataFrame:
    """Tagged union of candles and ticks as one long table."""
    def candle(rows, kind):
        return rows.select(
            "market_code", F.lit(kind).alias("type"), (F.col("start") * 1000).alias("ts"),
            "open", "high", "low", "close", "volume",
        )

    trades = ticks.select(
        "market_code", F.lit("trade_tick").alias("type"), F.unix_millis("ts").alias("ts"),
        "price", "volume", map_side(F.col("ask_bid")).alias("side"),
    )
    return (
        candle(seconds, "candle_second").unionByName(candle(minutes, "candle_minute"))
        .unionByName(trades, allowMissingColumns=True)
        .select("market_code", "type", "ts", "open", "high", "low", "close", "volume", "price", "side")
    )


def in_time_order(stream: DataFrame) -> DataFrame:
    """The stream sorted by (market, ts) over range partitions, ready to be written."""
    return stream.orderBy("market_code", "ts")


def current_price(kind: Column, price: Column, close: Column) -> Column:
    return F.when(kind == "trade_tick", price).otherwise(close)


def event_type_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("type").agg(F.count(F.lit(1)).alias("events"))


def latest_events(stream: DataFrame, kind: str | None = None, limit: int = LATEST_EVENTS, tie: tuple[str, ...] = ()) -> DataFrame:
    chosen = stream if kind is None else stream.filter(F.col("type") == kind)
    return chosen.orderBy(F.desc("ts"), *tie).limit(limit)


def trade_page(executions: DataFrame, market: str, cursor=None, limit: int = TRADES_DEFAULT) -> DataFrame:
    """Newest trades of a market before the cursor (executed_at, execution_id)."""
    rows = executions.filter(F.col("market_code") == market)
    if cursor is not None:
        ts, key = F.lit(cursor[0]), F.lit(cursor[1])
        at = F.col("executed_at")
        rows = rows.filter((at <= ts) & ((at < ts) | (F.col("execution_id") < key)))
    return rows.orderBy(F.desc("executed_at"), F.desc("execution_id")).limit(min(limit, TRADES_MAX))


def kst_day_slice(rows: DataFrame, day, ts: str = "ts") -> DataFrame:
    """Rows of one KST calendar day."""
    return rows.filter(within(F.col(ts), *kst_day(day)))


def by_kst_day(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with their KST day, the partition column of day-sliced datasets."""
    return rows.withColumn("trade_date", kst_date(F.col(ts)))


def range_filter(orders: DataFrame, from_ts: int = 0, to_ts: int = 0) -> DataFrame:
    """Recorded orders within [from, to] in epoch ms; 0 leaves an end open."""
    test = F.lit(True)
    if from_ts:
        test = test & (F.col("ts") >= from_ts)
    if to_ts:
        test = test & (F.col("ts") <= to_ts)
    return orders.filter(test)


# ---- sequential state --------------------------------------------------------------------

def hysteresis(
    samples: DataFrame, keys: list[str], order: list[str], high: float, low: float, slice_seconds: int = 600, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Flag that rises at `high`, falls at `low` and otherwise keeps its state."""
    mark = F.when(F.col("value") >= high, 1).when(F.col("value") <= low, 0)
    out = running(samples, keys, order, Slices("ts", slice_seconds, slice_rows), {"mark": ("last", mark)})
    return out.withColumn("active", F.coalesce(F.col("mark") == 1, F.lit(False))).drop("mark")


def max_over_readers(samples: DataFrame, keys: list[str]) -> DataFrame:
    """One lag value per poll: the largest over all readers, never below zero."""
    return samples.groupBy(*keys, "ts").agg(F.greatest(F.max("value"), F.lit(0)).alias("value"))


def market_load(readings: DataFrame, order: list[str], slice_seconds: int = 600, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Offsets per second since the previous reading; 0 if first, idle or not later."""
    seen = previous(
        readings, ["market_code"], order, Slices("ts", slice_seconds, slice_rows),
        {"before_offset": F.col("offset"), "before_ts": F.col("ts")},
    )
    elapsed = (F.unix_micros("ts") - F.unix_micros("before_ts")) / 1e6
    moved = F.col("offset") - F.col("before_offset")
    load = F.when((elapsed > 0) & (moved > 0), moved / elapsed).otherwise(0.0)
    return seen.withColumn("load", load).drop("before_offset", "before_ts")


def gauge_trend(samples: DataFrame, keys: list[str], order: list[str], slice_seconds: int = 600, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Change of a gauge since its previous poll."""
    seen = previous(samples, keys, order, Slices("ts", slice_seconds, slice_rows), {"before": F.col("value")})
    return seen.withColumn("delta", F.col("value") - F.col("before")).drop("before")


def asof_delta(
    samples: DataFrame, keys: list[str], tie: str, seconds: int = 60, slice_seconds: int = 600, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Every sample against the newest one taken at least `seconds` earlier.

    Each sample also asks a question placed `seconds` before it; walking both in time order
    answers all questions in one pass.
    """
    both = samples.select("*", F.explode(F.array(
        F.struct(F.col("ts").alias("at"), F.lit(0).alias("asks")),
        F.struct((F.col("ts") - F.expr(f"interval {seconds} seconds")).alias("at"), F.lit(1).alias("asks")),
    )).alias("walk")).select("*", "walk.at", "walk.asks").drop("walk")
    known = F.when(F.col("asks") == 0, F.col("value"))
    answered = running(both, keys, ["at", "asks", tie], Slices("at", slice_seconds, slice_rows), {"before": ("last", known)})
    return (
        answered.filter(F.col("asks") == 1).drop("at", "asks")
        .withColumn("delta", F.col("value") - F.col("before"))
    )


def price_history(prices: DataFrame, order: list[str], size: int = HISTORY) -> DataFrame:
    """Per market the last prices, oldest first, and the newest price.

    The row-number limit is applied before the shuffle, so only `size` rows per market and
    task travel.
    """
    newest = Window.partitionBy("market_code").orderBy(*[F.col(c).desc() for c in order])
    recent = prices.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= size)
    packed = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "price")))
    return (
        recent.groupBy("market_code").agg(packed.alias("packed"))
        .select("market_code", F.col("packed.price").alias("prices"))
        .withColumn("price", F.element_at("prices", -1))
        .orderBy("market_code")
    )


def quote_ladder(prices: DataFrame, tie: str, seconds: int = QUOTE_SECONDS) -> DataFrame:
    """Buy and sell quotes around the last price of every interval, in order format."""
    last = prices.groupBy("market_code", bucket(F.col("ts"), seconds).alias("interval_start")).agg(
        F.max_by("price", F.struct("ts", tie)).alias("price")
    )
    quotes = F.explode(F.array(
        F.struct(F.lit("BUY").alias("side"), (F.col("price") * (1 - QUOTE_SPREAD)).alias("quote")),
        F.struct(F.lit("SELL").alias("side"), (F.col("price") * (1 + QUOTE_SPREAD)).alias("quote")),
    ))
    sided = last.select("market_code", "interval_start", quotes.alias("q")).select("market_code", "interval_start", "q.*")
    return with_price_text(sided, "quote", "price").withColumn("quantity", quantity_text(F.lit(QUOTE_QUANTITY))).drop("quote")
