"""Run sessions as a stream of heartbeats and reports, with outcome and note.

Heartbeats are condensed to half lifetimes; of each run a micro-batch touches, the slots are read and its
sessions formed anew, so a late heartbeat joins two sessions or extends one, and the session it takes the
place of is deleted. Of the reports the newest of each run counts.

With a retention, sessions that ended farther back than it, counted from the newest heartbeat, move with
their slots to tables of rows that are only added; a heartbeat later than that begins a session of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.operators.runs import HEARTBEAT_SECONDS, beat_slots, numbered_slots, session_outcomes, slot_sessions
from tidebook.sources.versions import GONE, Retirement, Table, VersionStore

TABLES = {
    "slots": Table(("run_id", "slot")), "sessions": Table(("run_id", "started_at")), "reports": Table(("run_id",)), "ended": Table(),
}


def session_store(spark: SparkSession, root: str, keep: int = 8) -> VersionStore:
    return VersionStore(spark, root, TABLES, keep)


def session_job(
    beats: DataFrame, reports: DataFrame, root: str, checkpoint: str, ttl: int = HEARTBEAT_SECONDS,
    retention: str | None = None, keep: int = 8,
):
    """Writer of the stream over beats (run_id, ts) and reports (run_id, at, status, message); trigger and start it."""
    both = beats.select("run_id", "ts").unionByName(reports.select("run_id", "at", "status", "message"), allowMissingColumns=True)

    def retire(store: VersionStore) -> Retirement:
        newest = store.newest("slots").agg(F.max("last_beat") - F.expr(f"interval {retention}")).first()[0]
        if newest is None:
            return {}
        # A slot goes when the silence after it is long enough to have ended its session.
        return {
            "sessions": (F.col("last_beat") >= F.lit(newest), "ended"),
            "slots": (F.col("ends") >= F.lit(newest), None),
        }

    def step(batch: DataFrame, number: int) -> None:
        store = session_store(batch.sparkSession, root, keep)
        if store.committed(number):
            return
        found = beat_slots(batch.filter(F.col("ts").isNotNull()), ttl)
        touched = found.select("run_id")
        shape = found.withColumn("ends", F.col("last_beat"))
        before = store.newest("slots", like=shape, touched=touched)
        slots = before.drop("ends").unionByName(found).groupBy("run_id", "slot").agg(
            F.min("first_beat").alias("first_beat"), F.max("last_beat").alias("last_beat"), F.sum("beats").alias("beats")
        )
        sessions = slot_sessions(slots, ttl).select("run_id", "started_at", "last_beat", "beats")
        old = store.newest("sessions", like=sessions.withColumn(GONE, F.lit(False)), touched=touched)
        gone = old.join(sessions.select("run_id", "started_at"), ["run_id", "started_at"], "left_anti").withColumn(GONE, F.lit(True))
        changed = sessions.withColumn(GONE, F.lit(False)).unionByName(gone)
        # Each slot knows the last heartbeat of its session.
        ends = F.max("last_beat").over(Window.partitionBy("run_id", "session"))
        ended = numbered_slots(slots, ttl).withColumn("ends", ends).drop("session")
        reported = batch.filter(F.col("at").isNotNull()).select("run_id", "at", "status", "message")
        known = store.newest("reports", like=reported, touched=reported.select("run_id"))
        newest = known.unionByName(reported).groupBy("run_id").agg(F.max_by(F.struct("at", "status", "message"), "at").alias("o"))
        store.commit(number, {
            "slots": ended.select("run_id", "slot", "first_beat", "last_beat", "beats", "ends"), "sessions": changed,
            "reports": newest.select("run_id", "o.*"),
        }, retire if retention else None)

    return both.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def current_sessions(store: VersionStore, now, ttl: int = HEARTBEAT_SECONDS) -> DataFrame:
    """All sessions with their outcome at `now`, as `run_sessions` gives them."""
    sessions = store.newest("sessions")
    whole = sessions.unionByName(store.newest("ended", like=sessions)).drop(GONE)
    return session_outcomes(whole, store.newest("reports"), now, ttl)
