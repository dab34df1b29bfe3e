"""Requests answered anew, as a stream that is as exact as the batch form.

The state is a table of requests with the answer given to each. A micro-batch may bring requests of any time:
for every key it touches, the walk begins again at the request last answered before the earliest new one, and
answers that change are written again. So the table always equals `accepted_requests` over all requests so far.

With a retention, requests older than it (and a lifetime) move out, counted from the newest one: the answered
ones to a table of rows that are only added, the others go. A request that comes later than that is walked as
if what moved out had not been there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators.idempotency import REQUEST_WINDOW, accepted_requests
from tidebook.sources.versions import Retirement, Table, VersionStore


def accept_store(spark: SparkSession, root: str, keep: int = 8) -> VersionStore:
    return VersionStore(spark, root, {"requests": Table(("key", "id")), "settled": Table()}, keep)


def accept_job(
    requests: DataFrame, root: str, checkpoint: str, key: str = "client_request_id", id_column: str = "id",
    seconds: int = REQUEST_WINDOW, retention: str | None = None, keep: int = 8,
):
    """Writer of the stream over (key, ts, unique id); give it a trigger and start it."""
    named = requests.select(F.col(key).alias("key"), F.col(id_column).alias("id"), "ts")

    def retire(store: VersionStore) -> Retirement:
        span = F.expr(f"interval {retention}") + F.expr(f"interval {seconds} seconds")
        newest = store.newest("requests").agg(F.max("ts") - span).first()[0]
        if newest is None:
            return {}
        return {"requests": (F.col("ts") >= F.lit(newest), "settled")}

    def step(batch: DataFrame, number: int) -> None:
        store = accept_store(batch.sparkSession, root, keep)
        if store.committed(number):
            return
        new = batch.filter(F.col("ts").isNotNull()).groupBy("key", "id").agg(F.min("ts").alias("ts"))
        shape = new.withColumn("answered", F.lit(False))
        known = store.newest("requests", like=shape, touched=new.select("key"))
        new = new.join(known.select(F.col("key").alias("__key"), F.col("id").alias("__id")),
                       F.col("key").eqNullSafe(F.col("__key")) & F.col("id").eqNullSafe(F.col("__id")), "left_anti")
        begins = new.groupBy(F.col("key").alias("__key")).agg(F.min("ts").alias("__from"))
        touched = known.join(begins, F.col("key").eqNullSafe(F.col("__key")))
        # Of the requests before the earliest new one, the last answered is all the walk needs.
        later = touched.filter(F.col("ts") >= F.col("__from")).select("key", "id", "ts", "answered")
        last = (
            touched.filter((F.col("ts") < F.col("__from")) & F.col("answered"))
            .groupBy("key").agg(F.max_by(F.struct("id", "ts", "answered"), F.struct("ts", "id")).alias("l")).select("key", "l.*")
        )
        walk = later.unionByName(last).unionByName(new.withColumn("answered", F.lit(None).cast("boolean")))
        given = accepted_requests(walk, "key", "id", seconds).select(F.col("key").alias("__key"), F.col("id").alias("__id"), F.lit(True).alias("__now"))
        judged = walk.join(given, F.col("key").eqNullSafe(F.col("__key")) & F.col("id").eqNullSafe(F.col("__id")), "left")
        now = F.coalesce("__now", F.lit(False))
        changed = judged.filter(F.col("answered").isNull() | (F.col("answered") != now)).select("key", "id", "ts", now.alias("answered"))
        store.commit(number, {"requests": changed}, retire if retention else None)

    return named.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def answered_requests(store: VersionStore) -> DataFrame:
    """Requests answered anew so far: key, id, ts."""
    rows = store.newest("requests")
    return rows.unionByName(store.newest("settled", like=rows)).filter("answered").select("key", "id", "ts")
