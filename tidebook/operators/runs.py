"""Run sessions and run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.clock import bucket, moment

# Heartbeat lifetime, history lengths, owner kept in the history, labels.
HEARTBEAT_SECONDS = 120
HISTORY_LENGTH = 5
RECENT_RUNS = 3
HISTORY_OWNER = "replayengine"
EXPIRED_NOTE = "세션이 하트비트 없이 만료되어 자동으로 종료 처리되었습니다 (프로세스 응답 없음으로 추정)"
LABELS = {
    "running": "실행 중",
    "zombie": "오류 추정 종료",
    "COMPLETED": "정상 종료",
    "STOPPED": "사용자 중지",
    "FAILED": "오류로 종료",
}


def beat_slots(beats: DataFrame, ttl: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Heartbeats condensed to one row per run and half lifetime.

    Two beats of such a slot are never apart long enough to break a session.
    """
    return beats.groupBy("run_id", bucket(F.col("ts"), max(1, ttl // 2)).alias("slot")).agg(
        F.min("ts").alias("first_beat"), F.max("ts").alias("last_beat"), F.count(F.lit(1)).alias("beats")
    )


def numbered_slots(slots: DataFrame, ttl: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Slots with the number of their session; only the slots need ordering."""
    in_order = Window.partitionBy("run_id").orderBy("slot")
    silence = F.unix_micros("first_beat") - F.unix_micros(F.lag("last_beat").over(in_order))
    numbered = slots.withColumn("breaks", F.coalesce((silence >= ttl * 1_000_000).cast("int"), F.lit(1)))
    return numbered.withColumn("session", F.sum("breaks").over(in_order)).drop("breaks")


def slot_sessions(slots: DataFrame, ttl: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Spans of slots without a silence of `ttl` seconds."""
    return numbered_slots(slots, ttl).groupBy("run_id", "session").agg(
        F.min("first_beat").alias("started_at"), F.max("last_beat").alias("last_beat"), F.sum("beats").alias("beats")
    )


def heartbeat_sessions(beats: DataFrame, ttl: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Spans of (run_id, ts) heartbeats without a silence of `ttl` seconds."""
    return slot_sessions(beat_slots(beats, ttl), ttl)


def run_sessions(beats: DataFrame, outcomes: DataFrame, now, ttl: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Sessions with their outcome: released as reported, FAILED when they fell silent."""
    return session_outcomes(heartbeat_sessions(beats, ttl), outcomes, now, ttl)


def session_outcomes(sessions: DataFrame, outcomes: DataFrame, now, ttl: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Outcome and note of sessions (run_id, started_at, last_beat, beats) from the runs' newest reports."""
    newest = outcomes.groupBy("run_id").agg(F.max_by(F.struct("at", "status", "message"), "at").alias("o"))
    joined = sessions.join(newest, "run_id", "left")
    expires = F.col("last_beat") + F.expr(f"interval {ttl} seconds")
    released = F.coalesce((F.col("o.at") >= F.col("started_at")) & (F.col("o.at") < expires), F.lit(False))
    silent = expires <= F.lit(moment(now))
    return joined.select(
        "run_id", "started_at", "beats",
        F.when(released, F.col("o.status")).when(silent, "FAILED").otherwise("IN_PROGRESS").alias("status"),
        F.when(released, F.col("o.at")).when(silent, expires).alias("ended_at"),
        F.when(released, F.col("o.message")).when(silent, EXPIRED_NOTE).alias("message"),
    )


def append_note(message, note):
    """Run message with a note added."""
    return F.when(F.coalesce(message, F.lit("")) == "", note).otherwise(F.concat_ws(" | ", message, note))


def run_history(runs: DataFrame, limit: int = HISTORY_LENGTH) -> DataFrame:
    """Newest finished replay runs."""
    finished = runs.filter((F.col("owner") == HISTORY_OWNER) & F.col("ended_at").isNotNull())
    return finished.orderBy(F.desc("ended_at"), F.desc("run_id")).limit(limit)


def recent_runs(runs: DataFrame, limit: int = RECENT_RUNS) -> DataFrame:
    """Last, previous and second previous run with their slot 0, 1, 2."""
    newest = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)
    return newest.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("started_at"), F.desc("run_id"))) - 1)


def run_labels(runs: DataFrame) -> DataFrame:
    """Outcome label of every run; an unfinished run that is not the newest one is a zombie."""
    newest = runs.agg(F.max(F.struct("started_at", "run_id")).alias("n")).select("n.*", F.lit(True).alias("newest"))
    marked = runs.join(F.broadcast(newest), ["started_at", "run_id"], "left")
    open_run = F.col("status") == "IN_PROGRESS"
    label = F.when(open_run & F.col("newest").isNotNull(), LABELS["running"]).when(open_run, LABELS["zombie"])
    for status in ("COMPLETED", "STOPPED", "FAILED"):
        label = label.when(F.col("status") == status, LABELS[status])
    return marked.withColumn("label", label.otherwise(F.coalesce(F.nullif("status", F.lit("")), F.lit("-")))).drop("newest")
