"""Decode JSON messages of the three event topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.clock import parse_iso
from tidebook.functions.ticks import wire_amount
from tidebook.schemas import ASSIGNMENT_EVENT, EXECUTION_EVENT, ORDER_EVENT

# Message types.
ORDER_TYPES = ("NEW", "CANCEL")
ASSIGNMENT_TYPES = ("ASSIGNED", "RELEASED")


def _fields(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def _decode(raw: DataFrame, schema: str, types: tuple[str, ...] | None, body: str) -> DataFrame:
    """Add the message fields and `rejected`; all other columns of `raw` are kept.

    A message is one JSON object whose known fields are texts. Empty texts become null.
    """
    text = F.col(body)
    names = _fields(schema)
    parsed = F.from_json(text, schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rest = [c for c in raw.columns if c != body]
    # Generated columns are parsed once per message; a filter on plain struct fields would be
    # pushed below the projection and parse again for every field it tests.
    out = raw.select(*rest, body, F.inline_outer(F.array(parsed)))
    # A known field that holds a number, a flag or a nested value is not a text; what lies in
    # other fields does not matter. The pattern spares messages of texts only, which are nearly
    # all, the second parse.
    some_bare = text.rlike(r'"\s*:\s*[^"\s]')
    kinds = F.from_json(text, "map<string, variant>")
    odd = F.map_filter(kinds, lambda name, value: name.isin(*names) & ~F.coalesce(F.schema_of_variant(value), F.lit("VOID")).isin("STRING", "VOID"))
    not_text = some_bare & F.coalesce(F.size(odd) > 0, F.lit(False))
    trimmed = F.trim(text)
    whole = F.startswith(trimmed, F.lit("{")) & F.endswith(trimmed, F.lit("}"))
    bad = F.col("_broken").isNotNull() | ~whole | not_text
    if types is not None:
        bad = bad | ~F.col("type").isin(*types)
    return out.select(
        *rest, body, *[F.nullif(F.col(n), F.lit("")).alias(n) for n in names],
        F.coalesce(bad, F.lit(True)).alias("rejected"),
    )


def decode_orders(raw: DataFrame, body: str = "body") -> DataFrame:
    return _decode(raw, ORDER_EVENT, ORDER_TYPES, body)


def decode_executions(raw: DataFrame, body: str = "body") -> DataFrame:
    return _decode(raw, EXECUTION_EVENT, None, body)


def decode_assignments(raw: DataFrame, body: str = "body") -> DataFrame:
    return _decode(raw, ASSIGNMENT_EVENT, ASSIGNMENT_TYPES, body)


def rejects(decoded: DataFrame, body: str = "body") -> DataFrame:
    """Side table of messages that were skipped."""
    return decoded.filter("rejected").select(body)


def order_rows(decoded: DataFrame, *keep: str) -> DataFrame:
    """Typed order events as the ledger takes them."""
    return decoded.filter(~F.col("rejected")).select(
        "type", F.col("orderId").alias("order_id"), F.col("market").alias("market_code"), "side",
        wire_amount(F.col("price")).alias("price"), wire_amount(F.col("quantity")).alias("quantity"),
        parse_iso(F.col("acceptedAt")).alias("submitted_at"), F.col("clientRequestId").alias("client_request_id"),
        "mode", parse_iso(F.col("canceledAt")).alias("canceled_at"),
        F.col("sourceOrderId").alias("source_order_id"), *keep,
    )


def execution_rows(decoded: DataFrame, executed_at: Column, *keep: str) -> DataFrame:
    """Typed executions; the message carries no time, so the ingest time is passed in."""
    return decoded.filter(~F.col("rejected")).select(
        F.col("market").alias("market_code"), F.col("buyOrderId").alias("buy_order_id"),
        F.col("sellOrderId").alias("sell_order_id"), wire_amount(F.col("price")).alias("price"),
        wire_amount(F.col("quantity")).alias("quantity"), executed_at.alias("executed_at"), *keep,
    )


def assignment_rows(decoded: DataFrame, *keep: str) -> DataFrame:
    return decoded.filter(~F.col("rejected")).select(
        "type", F.col("market").alias("market_code"), F.col("engineInstanceId").alias("engine_instance_id"),
        parse_iso(F.col("at")).alias("at"), *keep,
    )
