"""Price ticks and number texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.schemas import AMOUNT, TICK_TIERS

# Number texts accepted on the wire.
PLAIN_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NAMED_NUMBER = r"(?i)^([+-]?inf|[+-]?infinity|nan)$"
QUANTITY_DECIMALS = 8


def _by_tier(price: Column, value) -> Column:
    chain = None
    for low, tick, decimals in TICK_TIERS[:-1]:
        picked = F.lit(value(tick, decimals))
        chain = F.when(price >= low, picked) if chain is None else chain.when(price >= low, picked)
    _, tick, decimals = TICK_TIERS[-1]
    return chain.otherwise(F.lit(value(tick, decimals)))


def tick_size(price: Column) -> Column:
    return _by_tier(price, lambda tick, decimals: tick)


def tick_decimals(price: Column) -> Column:
    return _by_tier(price, lambda tick, decimals: decimals)


def on_tick(ratio: Column) -> Column:
    """Is price / tick a whole number, up to an error of 1e-6?"""
    return F.abs(ratio - F.rint(ratio)) < 1e-6


def with_ticks(rows: DataFrame, price: str) -> DataFrame:
    """Add `tick`, `decimals` and `ratio` of a price column.

    The columns are added in steps. One nested expression would repeat the tier chain for
    every use and grow past what the JVM compiles.
    """
    tiered = rows.withColumns({"tick": tick_size(F.col(price)), "decimals": tick_decimals(F.col(price))})
    return tiered.withColumn("ratio", F.col(price) / F.col("tick"))


def half_up(x: Column) -> Column:
    """Nearest integer of a non-negative double, halves upwards."""
    whole = F.floor(x)
    return F.when(x - whole >= 0.5, whole + 1).otherwise(whole)


def round_to_tick(ratio: Column, tick: Column) -> Column:
    return half_up(ratio).cast("double") * tick


def _fixed(x: Column, decimals: int) -> Column:
    return x.cast(f"decimal(38,{decimals})").cast("string")


def price_text(rounded: Column, decimals: Column) -> Column:
    """Rounded price written with the decimals of its tier."""
    chain = F.when(decimals == 0, _fixed(rounded, 0))
    for d in range(1, 9):
        chain = chain.when(decimals == d, _fixed(rounded, d))
    return chain


def with_price_text(rows: DataFrame, price: str, out: str = "price_text") -> DataFrame:
    """Add the order text of a price: rounded to its tick, with the decimals of its tier."""
    rounded = with_ticks(rows, price).withColumn("rounded", round_to_tick(F.col("ratio"), F.col("tick")))
    texts = rounded.withColumn(out, price_text(F.col("rounded"), F.col("decimals")))
    return texts.drop("tick", "decimals", "ratio", "rounded")


def quantity_text(quantity: Column) -> Column:
    return _fixed(quantity, QUANTITY_DECIMALS)


def wire_double(text: Column) -> Column:
    """Double from a wire text; null for malformed or overflowing input."""
    plain = F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
    named = F.when(text.rlike(NAMED_NUMBER), text.try_cast("double"))
    finite = F.when(F.abs(plain) < float("inf"), plain)
    return F.coalesce(finite, named)


def wire_amount(text: Column) -> Column:
    """Exact ledger decimal from a wire text, rounded half up to 8 places."""
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast(AMOUNT))


def book_price(price: Column) -> Column:
    """Matching price: cut, not rounded, to 8 places."""
    return F.floor(price.cast("decimal(38,18)"), F.lit(8)).cast(AMOUNT)
