"""Schemas, dimensions and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AMOUNT = "decimal(24,8)"

# Order and run vocabulary.
SIDES = ("BUY", "SELL")
MODES = ("PAPER_TRADING", "REPLAY")
STATUSES = ("ACCEPTED", "PARTIALLY_FILLED", "FILLED", "CANCELED")
OPEN_STATUSES = ("ACCEPTED", "PARTIALLY_FILLED")

# The traded markets in partition order (code, Korean name, symbol).
MARKETS = (
    ("KRW-USDT", "테더", "USDT"),
    ("KRW-BTC", "비트코인", "BTC"),
    ("KRW-XRP", "리플", "XRP"),
    ("KRW-ETH", "이더리움", "ETH"),
    ("KRW-ONDO", "온도파이낸스", "ONDO"),
    ("KRW-LA", "라이덱스", "LA"),
    ("KRW-SHIB", "시바이누", "SHIB"),
    ("KRW-RE", "리버스", "RE"),
    ("KRW-DOGE", "도지코인", "DOGE"),
    ("KRW-SLX", "솔렛수", "SLX"),
    ("KRW-KAITO", "카이토", "KAITO"),
    ("KRW-SOL", "솔라나", "SOL"),
    ("KRW-XLM", "스텔라루멘", "XLM"),
    ("KRW-WLD", "월드코인", "WLD"),
    ("KRW-MIRA", "미라", "MIRA"),
    ("KRW-ERA", "에라", "ERA"),
    ("KRW-ADA", "에이다", "ADA"),
    ("KRW-AI", "에이아이", "AI"),
    ("KRW-NEAR", "니어프로토콜", "NEAR"),
    ("KRW-ARX", "아크스", "ARX"),
)
MARKET_CODES = tuple(code for code, _, _ in MARKETS)

# Fixed values: (lowest price, tick, decimals shown), highest tier first.
TICK_TIERS = (
    (2_000_000.0, 1000.0, 0),
    (1_000_000.0, 500.0, 0),
    (500_000.0, 100.0, 0),
    (100_000.0, 50.0, 0),
    (10_000.0, 10.0, 0),
    (1_000.0, 1.0, 0),
    (100.0, 0.1, 1),
    (10.0, 0.01, 2),
    (1.0, 0.001, 3),
    (0.1, 0.0001, 4),
    (0.01, 0.00001, 5),
    (0.001, 0.000001, 6),
    (0.0001, 0.0000001, 7),
    (0.0, 0.00000001, 8),
)

ORDER_EVENT = (
    "type string, orderId string, market string, side string, price string, quantity string, "
    "acceptedAt string, clientRequestId string, mode string, canceledAt string, sourceOrderId string"
)
EXECUTION_EVENT = (
    "market string, buyOrderId string, sellOrderId string, price string, quantity string"
)
ASSIGNMENT_EVENT = "type string, market string, engineInstanceId string, at string"

TRADE_ORDER = (
    "order_id string, client_request_id string, market_code string, side string, "
    f"price {AMOUNT}, quantity {AMOUNT}, remaining_quantity {AMOUNT}, status string, mode string, "
    "submitted_at timestamp, canceled_at timestamp, created_at timestamp, source_order_id string"
)
EXECUTION = (
    "execution_id string, market_code string, buy_order_id string, sell_order_id string, "
    f"price {AMOUNT}, quantity {AMOUNT}, mode string, executed_at timestamp"
)
ASSIGNMENT = (
    "assignment_id string, market_code string, engine_instance_id string, "
    "assigned_at timestamp, released_at timestamp"
)

_OHLCV = "ts: bigint, open: double, high: double, low: double, close: double, volume: double"
CANDLE_BATCH_FILE = (
    "market string, range struct<start: string, end: string>, candles struct<"
    f"days: array<struct<{_OHLCV}>>, weeks: array<struct<{_OHLCV}>>, "
    f"months: array<struct<{_OHLCV}>>, years: array<struct<{_OHLCV}>>>"
)
STREAM_FILE = (
    "market string, range struct<start: string, end: string>, events array<struct<"
    f"type: string, {_OHLCV}, price: double, side: string>>"
)
ORDER_RECORD_FILE = (
    "market string, range struct<start: string, end: string>, orders array<struct<"
    "ts: bigint, side: string, price: string, quantity: string, orderId: string>>"
)
ORDER_RECORD = (
    "market string, trade_date date, ts bigint, side string, price string, quantity string, "
    "order_id string"
)


def market_dim(spark: SparkSession) -> DataFrame:
    """The market dimension; `market_index` is the partition number of the market."""
    rows = [(i, code, name, symbol) for i, (code, name, symbol) in enumerate(MARKETS)]
    return spark.createDataFrame(
        rows, "market_index int, market_code string, korean_name string, symbol string"
    )


def is_market(code: Column) -> Column:
    return F.coalesce(code.isin(*MARKET_CODES), F.lit(False))


def market_index(code: Column) -> Column:
    """Partition number of a market, null for an unknown one."""
    position = F.array_position(F.array(*[F.lit(c) for c in MARKET_CODES]), code)
    return F.when(position > 0, (position - 1).cast("int"))
