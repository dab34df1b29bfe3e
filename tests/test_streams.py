"""Streams over restarts, late and repeated input, equal to the batch form; stores of bounded size."""

import random
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_ledger import EVENT, FILL, START, _random_history, cancel, fill, new, state
from tidebook.operators import idempotency, ledger, metrics, runs
from tidebook.session import work_folder
from tidebook.sources.versions import Table, VersionStore
from tidebook.streaming import accept, jobs, sessions
from tidebook.streaming import ledger as ledgers


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, schema, folder, per_batch=None):
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)


def drained(writer):
    ledgers.start(writer, True, "1 second").awaitTermination()


# ---- store -------------------------------------------------------------------------------

def test_store_keeps_the_newest_row_and_few_folders(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path), {"t": Table(("k",), buckets=4), "log": Table()}, keep=3)
    want, written = {}, 0
    for n in range(24):
        rows = [(f"k{(n * 7 + i) % 20}", n * 10 + i, False) for i in range(4)] + [(None, n, False)] + [(f"k{n % 20}x", n, n % 2 == 1)]
        want |= {k: v for k, v, _ in rows}
        written += 2
        if n % 2:
            want.pop(f"k{n % 20}x", None)
        changes = spark.createDataFrame(rows, "k string, v int, gone boolean")
        store.commit(n, {"t": changes, "log": spark.range(2).select((F.col("id") + n * 2).alias("id"))})
        store.commit(n, {"t": changes.withColumn("v", F.lit(-1))})  # a repeated batch changes nothing
        assert len(list((tmp_path / "t").iterdir())) <= 2 * 4 and len(list((tmp_path / "log").iterdir())) <= 18
        assert len(store._pointers()) <= 2
    assert {r.k: r.v for r in store.newest("t").collect()} == want
    assert sorted(r.id for r in store.newest("log").collect()) == list(range(48))
    keys = spark.createDataFrame([("k3",), (None,)], "k string")
    assert {r.k for r in store.newest("t", touched=keys).collect()} == {"k3", None}
    with pytest.raises(ValueError):
        store.commit(5, {})


def test_a_commit_that_fails_leaves_the_old_rows(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path), {"a": Table(("k",)), "b": Table(("k",))})
    one = spark.createDataFrame([(1, 1)], "k int, v int")
    store.commit(0, {"a": one, "b": one})
    bad = one.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.commit(1, {"a": one.withColumn("v", F.lit(2)), "b": bad})
    assert [r.v for t in ("a", "b") for r in store.newest(t).collect()] == [1, 1]
    store.commit(1, {"a": one.withColumn("v", F.lit(2)), "b": one.withColumn("v", F.lit(3))})
    assert [r.v for t in ("a", "b") for r in store.newest(t).collect()] == [2, 3]


# ---- ledger ------------------------------------------------------------------------------

def ledger_round(spark, root, **options):
    events, done = source(spark, EVENT, f"{root}/events"), source(spark, FILL, f"{root}/fills")
    drained(ledgers.ledger_job(events, done, f"{root}/store", f"{root}/checkpoint", **options))


def test_stream_ledger_equals_batch_over_restarts(spark):
    events, done = _random_history(5)
    draw = random.Random(4)
    draw.shuffle(events)
    draw.shuffle(done)
    root = work_folder(spark)
    expected = state(ledger.order_ledger(spark.createDataFrame(events, EVENT), spark.createDataFrame(done, FILL)))
    for part in range(3):
        # Fills may come before their orders; a third of them is delivered once more.
        put(spark, events[part::3], EVENT, f"{root}/events")
        put(spark, done[part::3] + done[:20], FILL, f"{root}/fills")
        ledger_round(spark, root, keep=1)
    assert state(ledgers.current_ledger(ledgers.ledger_store(spark, f"{root}/store"))) == expected


def test_fifty_batches_leave_a_bounded_state(spark, tmp_path):
    """Orders of a minute are closed in the next one; with a retention the state is that of a few minutes."""
    root, events, done = str(tmp_path), [], []
    for n in range(50):
        fresh = [new(f"o{n}-{i}", 2, n * 60 + i) for i in range(6)]
        fresh += [cancel(f"o{n - 1}-{i}", n * 60 + 10 + i) for i in (4, 5)] if n else []
        filled = [fill(f"o{n - 1}-{i}", f"o{n - 1}-{i + 1}", 2, n * 60 + 20 + i) for i in (0, 2)] if n else []
        if n == 45:
            filled.append(fill("o3-4", "o3-5", 2, n * 60 + 40))  # completes two orders canceled and retired long ago
        events, done = events + fresh, done + filled
        put(spark, fresh, EVENT, f"{root}/events")
        put(spark, filled or [], FILL, f"{root}/fills")
    lean = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}  # for speed
    usual = {k: spark.conf.get(k) for k in lean}
    for k, value in lean.items():
        spark.conf.set(k, value)
    try:
        writer = ledgers.ledger_job(
            source(spark, EVENT, f"{root}/events", 1), source(spark, FILL, f"{root}/fills", 1), f"{root}/store", f"{root}/c",
            retention="3 minutes", keep=4,
        )
        drained(writer)
    finally:
        for k, value in usual.items():
            spark.conf.set(k, value)
    store = ledgers.ledger_store(spark, f"{root}/store")
    assert store.pointer()["batch"][0] >= 49
    folders = {t: len(list((tmp_path / "store" / t).iterdir())) for t in ledgers.TABLES}
    assert max(folders.values()) <= 20, folders
    assert store.newest("orders").count() <= 12 * 6 and store.newest("pairs").count() <= 12 * 2
    assert store.newest("closed").count() >= 200
    expected = state(ledger.order_ledger(spark.createDataFrame(events, EVENT), spark.createDataFrame(done, FILL)))
    assert state(ledgers.current_ledger(store)) == expected
    assert {s for s, _, _ in expected.values()} == {"ACCEPTED", "FILLED", "CANCELED"} and expected["o3-4"][0] == "FILLED"


# ---- requests ----------------------------------------------------------------------------

REQUEST = "client_request_id string, ts timestamp, id bigint"


@pytest.mark.parametrize("retention", [None, "100 days"])
def test_accepted_requests_in_batches_with_late_rows(spark, retention):
    draw, clock, rows, root = random.Random(6), START, [], work_folder(spark)
    for i in range(400):
        clock += timedelta(seconds=draw.choice([0, 1, 300, 1200, 3600, 9000]))
        rows.append(("hot" if draw.random() < 0.6 else draw.choice(["a", "b", None]), clock, i))
    parts = [rows[i::5] for i in range(5)] if retention is None else [rows[i::5] for i in (3, 0, 4, 1, 2)]
    for n, part in enumerate(parts):
        put(spark, part + rows[:5], REQUEST, f"{root}/in")  # some come once more
        drained(accept.accept_job(source(spark, REQUEST, f"{root}/in"), f"{root}/store", f"{root}/c", retention=retention, keep=2))
        so_far = {r[2]: r for p in parts[: n + 1] for r in [*p, *rows[:5]]}
        expected = idempotency.accepted_requests(spark.createDataFrame(list(so_far.values()), REQUEST), "client_request_id", "id")
        found = accept.answered_requests(accept.accept_store(spark, f"{root}/store"))
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in expected.collect())


def test_settled_requests_leave_the_state(spark):
    root = work_folder(spark)
    rows = [("k", START + timedelta(minutes=20 * i), i) for i in range(300)]
    for n in range(10):
        put(spark, rows[n * 30 : n * 30 + 30], REQUEST, f"{root}/in")
        drained(accept.accept_job(source(spark, REQUEST, f"{root}/in"), f"{root}/store", f"{root}/c", retention="1 hour", keep=2))
    store = accept.accept_store(spark, f"{root}/store")
    assert store.newest("requests").count() < 150
    expected = idempotency.accepted_requests(spark.createDataFrame(rows, REQUEST), "client_request_id", "id")
    assert sorted(r.id for r in accept.answered_requests(store).collect()) == sorted(r.id for r in expected.collect())


# ---- sessions ----------------------------------------------------------------------------

BEAT, REPORT = "run_id string, ts timestamp", "run_id string, at timestamp, status string, message string"


def test_sessions_equal_batch_with_late_beats(spark):
    draw, root = random.Random(9), work_folder(spark)
    beats = [(draw.choice("abc"), START + timedelta(seconds=draw.randrange(0, 6000))) for _ in range(150)]
    reports = [(draw.choice("abcd"), START + timedelta(seconds=draw.randrange(0, 6200)), "COMPLETED", f"m{i}") for i in range(8)]
    now = START + timedelta(seconds=6050)
    for part in range(4):
        put(spark, beats[part::4], BEAT, f"{root}/beats")
        put(spark, reports[part::4], REPORT, f"{root}/reports")
        writer = sessions.session_job(
            source(spark, BEAT, f"{root}/beats"), source(spark, REPORT, f"{root}/reports"), f"{root}/store", f"{root}/c", keep=2
        )
        drained(writer)
        b = [x for p in range(part + 1) for x in beats[p::4]]
        r = [x for p in range(part + 1) for x in reports[p::4]]
        expected = runs.run_sessions(spark.createDataFrame(b, BEAT), spark.createDataFrame(r, REPORT), now)
        found = sessions.current_sessions(sessions.session_store(spark, f"{root}/store"), now)
        columns = expected.columns
        assert sorted(map(tuple, found.select(columns).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_ended_sessions_leave_the_state(spark):
    root = work_folder(spark)
    beats = [("r", START + timedelta(seconds=1000 * n + s)) for n in range(30) for s in (0, 40, 90)]
    for part in range(10):
        put(spark, beats[part * 9 : part * 9 + 9], BEAT, f"{root}/beats")
        put(spark, [("r", beats[part * 9 + 2][1], "STOPPED", "x")], REPORT, f"{root}/reports")
        drained(sessions.session_job(
            source(spark, BEAT, f"{root}/beats"), source(spark, REPORT, f"{root}/reports"), f"{root}/store", f"{root}/c",
            retention="10 minutes", keep=2,
        ))
    store = sessions.session_store(spark, f"{root}/store")
    assert store.newest("slots").count() < 30
    assert sessions.current_sessions(store, START + timedelta(days=1)).count() == 30


# ---- intake, archive, counts, lag --------------------------------------------------------

def test_ingest_stores_every_order_once(spark):
    root = work_folder(spark)
    for part in range(3):
        rows = [new(f"o{i}", 1, i, market="KRW-BTC") for i in range(part * 5, part * 5 + 8)] + [new(f"x{part}", 1, 99, market="KRW-NONE")]
        put(spark, rows, EVENT, f"{root}/in")
        jobs.ingest_stream(source(spark, EVENT, f"{root}/in"), f"{root}/store", f"{root}/checkpoint", drain=True, keep=1).awaitTermination()
    stored = jobs.order_store(spark, f"{root}/store").newest("orders")
    assert stored.count() == stored.select("order_id").distinct().count() == 18


def test_ingest_commits_flushes_and_forgets_old_ids(spark):
    root = work_folder(spark)
    put(spark, [new(f"o{i % 11}", 1, i, market="KRW-BTC") for i in range(24)], EVENT, f"{root}/in")
    jobs.ingest_stream(source(spark, EVENT, f"{root}/in"), f"{root}/store", f"{root}/c", limit=5, drain=True, keep=2, retention="3 seconds").awaitTermination()
    store = jobs.order_store(spark, f"{root}/store")
    assert store.pointer()["batch"] == [0, 4]
    assert store.newest("orders").count() >= 11
    assert store.newest("ids").count() <= 2 * 11


def test_archive_cuts_a_batch_into_flushes(spark, tmp_path):
    schema = "body string, offset bigint, ingested_at timestamp, market_code string"
    rows = [(f"m{i}", i, START + timedelta(seconds=i * 100), "A") for i in range(1200)]
    random.Random(2).shuffle(rows)
    put(spark, rows, schema, f"{tmp_path}/in")
    jobs.archive_stream(source(spark, schema, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c", drain=True).awaitTermination()
    files = sorted((f for f in (tmp_path / "out").rglob("*.json")), key=lambda f: int(f.parent.name.split("=")[1]))
    assert [len(f.read_text().splitlines()) for f in files] == [500, 500, 200]
    assert [f.parent.parent.parent.name for f in files] == [
        f"archived_on={(START + timedelta(seconds=s * 100)).date()}" for s in (499, 999, 1199)
    ]
    bodies = [line for f in files for line in f.read_text().splitlines()]
    assert [f'"body":"m{i}"' in b for i, b in enumerate(bodies)] == [True] * 1200


def test_live_counts_keep_late_rows_and_totals(spark):
    root, schema = work_folder(spark), "ts timestamp, kind string"
    for batch in ([0, 30], [3600], [7200], [10], [20, 7201]):
        put(spark, [(START + timedelta(seconds=s), "a" if s % 20 else "b") for s in batch], schema, f"{root}/in")
        counts = jobs.live_counts(source(spark, schema, f"{root}/in"), "ts", "n", "kind")
        jobs.upsert_stream(counts, f"{root}/counts", f"{root}/c", ["kind", "minute"], drain=True, keep=2).awaitTermination()
    found = {(r.kind, r.minute and (r.minute - START.replace(tzinfo=None)).seconds): r.n for r in jobs.current_rows(spark, f"{root}/counts", ["kind", "minute"]).collect()}
    assert found == {("a", None): 3, ("b", None): 4, ("a", 0): 2, ("b", 0): 2, ("b", 3600): 1, ("b", 7200): 1, ("a", 7200): 1}


def test_lag_of_a_file_stream(spark, tmp_path):
    for i in range(4):
        put(spark, [(i,)], "id int", f"{tmp_path}/in")
    recorder = jobs.LagRecorder(spark, f"{tmp_path}/lag", ends={"reader": lambda: {"source0-logOffset": 3}})
    spark.streams.addListener(recorder)
    try:
        query = source(spark, "id int", f"{tmp_path}/in", 1).writeStream.queryName("reader").foreachBatch(lambda b, n: None)
        query.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        import time

        for _ in range(50):  # the listener's end event comes from another thread
            if (tmp_path / "lag" / "_SUCCESS").exists():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(recorder)
    lags = metrics.consumer_lag(jobs.lag_samples(spark, f"{tmp_path}/lag")).orderBy("ts").collect()
    assert [(r.reader, r.lag) for r in lags][:4] == [("reader", 3), ("reader", 2), ("reader", 1), ("reader", 0)]


def test_offsets_of_topics():
    progress = {"timestamp": "2026-01-01T00:00:00.000Z", "sources": [{
        "startOffset": '{"orders":{"0":5}}', "endOffset": '{"orders":{"0":7,"1":1}}', "latestOffset": '{"orders":{"0":9,"1":1,"2":4}}'}]}
    assert [(r[1], r[3], r[4]) for r in jobs.lag_rows(progress, "r")] == [("source0-orders-0", 9, 7), ("source0-orders-1", 1, 1), ("source0-orders-2", 4, 0)]
