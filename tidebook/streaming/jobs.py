"""Structured Streaming jobs over the event topics: archive, intake, live counts, lag.

Sources are passed in as streaming DataFrames, so a job runs on Kafka topics and on files
alike. Every job takes its own checkpoint folder below the shared work folder, and tables that change by
key are kept by `sources.versions`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidebook.operators.ledger import insert_orders
from tidebook.operators.ordered import number_chunk, running
from tidebook.sources.versions import Retirement, Table, VersionStore

# Batch limits and trigger intervals.
ARCHIVE_INTERVAL = "30 seconds"
INGEST_INTERVAL = "2 seconds"
BATCH_MESSAGES = 500


def kafka_messages(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = BATCH_MESSAGES) -> DataFrame:
    """Messages of a topic; partition = market, offset = position in the market.

    A micro-batch takes `max_offsets` messages at most (None: all there are).
    """
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", "earliest")
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.col("value").cast("string").alias("body"), "partition", "offset", F.col("timestamp").alias("ingested_at")
    )


def _trigger(writer, interval: str, drain: bool):
    """A steady interval, or one pass over all data present."""
    return writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)


def with_flush(batch: DataFrame, order: list[str], limit: int, chunk_rows: int = 1 << 16) -> DataFrame:
    """Number a batch's messages along `order`, its first column a number, and cut them into flushes of `limit`."""
    placed = running(
        batch, [], order, number_chunk(F.col(order[0]), chunk_rows), {"__place": ("sum", F.lit(1))}, include_current=False
    )
    return placed.withColumn("flush", F.floor(F.coalesce("__place", F.lit(0)) / limit)).drop("__place")


def archive_stream(
    messages: DataFrame, path: str, checkpoint: str, order: list[str] = ("offset",), limit: int = BATCH_MESSAGES, drain: bool = False
) -> StreamingQuery:
    """Raw messages to JSON files of `limit` messages at most, by the day of a file's last message.

    A file is archived_on=<day>/batch=<n>/flush=<k>/part-*.json. A repeated batch writes over its own files:
    its messages and so its days are the same.
    """
    order = list(order)

    def store(batch: DataFrame, number: int) -> None:
        flushed = with_flush(batch, order, limit)
        day = F.to_date(F.max("ingested_at").over(Window.partitionBy("flush")))
        rows = flushed.withColumns({"archived_on": day, "batch": F.lit(number)})
        rows.repartition("flush").sortWithinPartitions("flush", *order).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("archived_on", "batch", "flush").json(path)

    writer = messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _trigger(writer, ARCHIVE_INTERVAL, drain).start()


# ---- intake ------------------------------------------------------------------------------

def order_store(spark: SparkSession, root: str, keep: int = 8) -> VersionStore:
    return VersionStore(spark, root, {"orders": Table(), "ids": Table(("id", "kind"))}, keep)


def _parts(batch: DataFrame, order: str, limit: int | None) -> Iterator[DataFrame]:
    """The batch in one piece, or its flushes one after the other."""
    if limit is None:
        yield batch
        return
    flushed = with_flush(batch, [order], limit)
    last = flushed.agg(F.max("flush")).first()[0]
    for k in range(0 if last is None else last + 1):
        yield flushed.filter(F.col("flush") == k).drop("flush")


def ingest_stream(
    orders: DataFrame, root: str, checkpoint: str, order: str = "offset", markets: DataFrame | None = None,
    any_market: bool = False, limit: int | None = None, retention: str | None = None, drain: bool = False, keep: int = 8,
) -> StreamingQuery:
    """Insert new orders into the order table, once each, and only those of known markets.

    Order ids and request ids stored so far are a table by id, and a batch looks up its own ids only. A
    batch that is repeated after a crash stores nothing twice. With `limit` a micro-batch is stored in flushes
    of that many messages, each a commit. With a retention, ids of orders submitted farther back than it, counted
    from the newest one, are forgotten, and only an order repeated later than that is stored again.
    """
    def retire(store: VersionStore) -> Retirement:
        newest = store.newest("ids").agg(F.max("at") - F.expr(f"interval {retention}")).first()[0]
        return {} if newest is None else {"ids": (F.col("at") >= F.lit(newest), None)}

    def ids_of(rows: DataFrame) -> DataFrame:
        both = F.explode(F.array(
            F.struct(F.col("order_id").cast("string").alias("id"), F.lit("order").alias("kind")),
            F.struct(F.col("client_request_id").cast("string").alias("id"), F.lit("request").alias("kind")),
        ))
        return rows.select(both.alias("i"), F.col("submitted_at").alias("at")).select("i.*", "at").filter("id is not null")

    def store_batch(batch: DataFrame, number: int) -> None:
        store = order_store(batch.sparkSession, root, keep)
        for part, rows in enumerate(_parts(batch, order, limit)):
            if store.committed(number, part):
                continue
            new = rows.filter(F.col("type") == "NEW")
            ids = ids_of(new)
            seen = store.newest("ids", like=ids, touched=ids.select("id", "kind"))
            kinds = dict(new.dtypes)
            stored = seen.filter("kind = 'order'").select(F.col("id").cast(kinds["order_id"]).alias("order_id"))
            requested = seen.filter("kind = 'request'").select(F.col("id").cast(kinds["client_request_id"]).alias("client_request_id"))
            fresh = insert_orders(new, stored, order, markets, any_market, requested)
            store.commit(number, {"orders": fresh, "ids": ids_of(fresh)}, retire if retention else None, part)

    writer = orders.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, INGEST_INTERVAL, drain).start()


# ---- live counts -------------------------------------------------------------------------

def upsert_stream(
    changes: DataFrame, root: str, checkpoint: str, keys: list[str], drain: bool = False, interval: str = INGEST_INTERVAL, keep: int = 8
) -> StreamingQuery:
    """Keep the changed rows of an update-mode query in a table by key."""
    def store(batch: DataFrame, number: int) -> None:
        VersionStore(batch.sparkSession, root, {"rows": Table(tuple(keys))}, keep).commit(number, {"rows": batch})

    writer = changes.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval, drain).start()


def current_rows(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """The table an upsert_stream keeps."""
    return VersionStore(spark, root, {"rows": Table(tuple(keys))}).newest("rows")


def live_counts(rows: DataFrame, ts: str, name: str, *by: str) -> DataFrame:
    """Counts per one-minute tumbling window and `by`, and running totals beside them; use update mode.

    The row without a minute is the total. There is no watermark, so late rows always count. The state is
    one counter per minute and group, and one per group.
    """
    minute = F.date_trunc("minute", F.col(ts))
    either = rows.select(*by, F.explode(F.array(minute, F.lit(None).cast("timestamp"))).alias("minute"))
    return either.groupBy(*by, "minute").agg(F.count(F.lit(1)).alias(name))


# ---- lag ---------------------------------------------------------------------------------

LAG = "reader string, part string, ts timestamp, latest_offset bigint, committed_offset bigint"


def _offsets(value, prefix: str) -> dict[str, int]:
    """Numbers of an offset document by place: topic and partition, or the fields of a file log."""
    if isinstance(value, str):
        value = json.loads(value)
    if isinstance(value, bool) or value is None:
        return {}
    if isinstance(value, int):
        return {prefix: value}
    found: dict[str, int] = {}
    for name, inner in value.items() if isinstance(value, dict) else ():
        found |= _offsets(inner, f"{prefix}-{name}" if prefix else name)
    return found


def lag_rows(progress: dict, reader: str, ends: dict[str, int] | None = None) -> list[tuple]:
    """(reader, part, ts, latest, committed) of every part of every source, from one progress report.

    `ends` has the latest offsets of sources that report none, such as files; without it they stand at the
    end of what they have read.
    """
    rows = []
    for number, source in enumerate(progress.get("sources", [])):
        prefix = f"source{number}"
        committed = _offsets(source.get("endOffset"), prefix)
        latest = _offsets(source.get("latestOffset"), prefix) or committed | {p: n for p, n in (ends or {}).items() if p in committed}
        started = _offsets(source.get("startOffset"), prefix)
        rows += [
            (reader, part, progress["timestamp"], offset, committed.get(part, started.get(part, 0))) for part, offset in sorted(latest.items())
        ]
    return rows


class LagRecorder(StreamingQueryListener):
    """Appends the offsets of every progress report of a session's queries to a table of lag samples.

    Reports are held in memory and written `every` so many, and when a query ends. `consumer_lag` reads
    the table. `ends` gives, for queries by name, the latest offsets of sources that do not report them.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 100, ends: dict[str, Callable[[], dict[str, int]]] | None = None):
        self.spark, self.path, self.every, self.ends = spark, path, every, ends or {}
        self.held: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        reader = progress.get("name") or progress["id"]
        self.held += lag_rows(progress, reader, self.ends[reader]() if reader in self.ends else None)
        if len(self.held) >= self.every:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        rows, self.held = self.held, []
        texts = self.spark.createDataFrame(rows, LAG.replace("ts timestamp", "ts string"))
        texts.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(self.path)


def lag_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAG).parquet(path)
