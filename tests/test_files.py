"""File datasets: writing, reading, listings."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidebook.operators import series
from tidebook.sources import files, tables

RECORD = "market string, ts bigint, side string, price string, quantity string, order_id string"
DAY_MS = 86_400_000
KST_MIDNIGHT = 1785596400000  # 2026-08-01T15:00:00Z


def rows(spark, *items):
    return spark.createDataFrame([(m, ts, "BUY", "1", "2", oid) for m, ts, oid in items], RECORD)


def ids(df):
    return sorted(r.order_id for r in df.collect())


def test_first_flush_replaces_later_ones_append(spark, tmp_path):
    root = str(tmp_path / "orders")
    assert files.read_order_records(spark, root).count() == 0
    files.write_order_records(rows(spark, ("A", KST_MIDNIGHT, "old"), ("A", KST_MIDNIGHT + DAY_MS, "next"), ("B", KST_MIDNIGHT, "b")), root, reset=True)
    files.write_order_records(rows(spark, ("A", KST_MIDNIGHT + 5, "new")), root, reset=True)
    files.write_order_records(rows(spark, ("A", KST_MIDNIGHT + 1, "more")), root, reset=False)
    # Only the day of that market is replaced.
    assert ids(files.read_order_records(spark, root)) == ["b", "more", "new", "next"]
    assert ids(files.read_order_records(spark, root, "A", "2026-08-02")) == ["more", "new"]
    assert ids(files.read_order_records(spark, root, day=date(2026, 8, 3))) == ["next"]
    plan = files.read_order_records(spark, root, "A", "2026-08-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_flushes_of_a_run(spark, tmp_path):
    root = str(tmp_path / "orders")
    a, b = "KRW-BTC", "KRW-ETH"
    files.write_order_records(rows(spark, (a, KST_MIDNIGHT, "old-a"), (b, KST_MIDNIGHT, "old-b")), root, reset=True)
    flushed = files.flush_order_records(rows(spark, (a, KST_MIDNIGHT + 1, "a1")), root, "run-1", 0)
    assert flushed == {a} and ids(files.read_order_records(spark, root)) == ["a1", "old-b"]
    second = rows(spark, (a, KST_MIDNIGHT + 2, "a2"), (b, KST_MIDNIGHT, "b1"))
    for _ in range(2):  # a repeated flush changes nothing
        assert files.flush_order_records(second, root, "run-1", 1) == {a, b}
        assert ids(files.read_order_records(spark, root)) == ["a1", "a2", "b1"]
    files.flush_order_records(rows(spark, (a, KST_MIDNIGHT + 3, "a3")), root, "run-2", 0)
    assert ids(files.read_order_records(spark, root)) == ["a3", "b1"]


@pytest.mark.parametrize("breaks", ["staging", "first folder", "second folder", "mark"])
def test_a_flush_that_breaks_off_leaves_one_copy(spark, tmp_path, monkeypatch, breaks):
    root = str(tmp_path / "orders")
    a, b = "KRW-BTC", "KRW-ETH"
    files.write_order_records(rows(spark, (a, KST_MIDNIGHT, "old-a"), (b, KST_MIDNIGHT, "old-b")), root, reset=True)
    files.flush_order_records(rows(spark, (a, KST_MIDNIGHT, "a0")), root, "run", 0)
    flush = rows(spark, (a, KST_MIDNIGHT + 1, "a1"), (b, KST_MIDNIGHT + 1, "b1"))
    folder, publish, calls = files._publish_folder, files.publish_json, []

    def broken_folder(*args):
        calls.append(args)
        if breaks == "first folder":
            raise OSError("lost")
        folder(*args)
        if breaks == "second folder":
            raise OSError("lost")

    def broken_publish(spark, name, content):
        if breaks == "staging" or (breaks == "mark" and name.endswith("done.json")):
            raise OSError("lost")
        return publish(spark, name, content)

    monkeypatch.setattr(files, "_publish_folder", broken_folder)
    monkeypatch.setattr(files, "publish_json", broken_publish)
    with pytest.raises(OSError, match="lost"):
        files.flush_order_records(flush, root, "run", 1)
    monkeypatch.undo()
    assert files.flush_order_records(flush, root, "run", 1) == {a, b}
    assert ids(files.read_order_records(spark, root)) == ["a0", "a1", "b1"]
    files.flush_order_records(rows(spark, (b, KST_MIDNIGHT + 2, "b2")), root, "run", 2)
    assert ids(files.read_order_records(spark, root)) == ["a0", "a1", "b1", "b2"]


def test_order_documents_and_dates(spark, tmp_path):
    def put(market, name, body):
        (tmp_path / market).mkdir(exist_ok=True)
        (tmp_path / market / name).write_text(body)

    document = {"market": "A", "range": {"start": "x", "end": "y"}, "orders": [
        {"ts": 2, "side": "BUY", "price": "1", "quantity": "1", "orderId": "o1"}, {"ts": 1, "side": "SELL", "price": "1", "quantity": "1", "orderId": "o2"}]}
    put("A", "20260801T150000Z_20260802T150000Z_orders.json", json.dumps(document, indent=2))
    put("B", "20260801T150000Z_20260802T150000Z_orders.json", json.dumps({"market": "B", "orders": []}))
    put("A", "20260731T145959Z_20260801T145959Z_orders.json", json.dumps({"market": "A", "orders": []}))
    put("A", "oops_orders.json", "{}")
    put("A", "20260601T150000Z_x_batch.json", "{}")
    read = files.read_order_documents(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.market, r.order_id, r.ts) for r in read] == [("A", "o1", 2), ("A", "o2", 1)]
    listed = files.list_files(spark, str(tmp_path), "*_orders.json")
    assert [r.date for r in files.replay_dates(listed).collect()] == ["2026-08-02", "2026-07-31"]
    assert files.replay_dates(files.list_files(spark, str(tmp_path / "none"), "*")).count() == 0


def test_market_documents(spark, tmp_path):
    candle = {"ts": 1, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 3.0}
    (tmp_path / "A").mkdir()
    (tmp_path / "A" / "s_e_batch.json").write_text(json.dumps({"market": "A", "candles": {"days": [candle], "weeks": [], "months": [candle], "years": []}}))
    (tmp_path / "A" / "s_e_stream.json").write_text(json.dumps({"market": "A", "events": [
        {"type": "candle_second", **candle}, {"type": "trade_tick", "ts": 2, "price": 7.0, "volume": 1.0, "side": "BUY"}]}))
    batch = files.read_market_documents(spark, str(tmp_path), "batch").orderBy("unit").collect()
    assert [(r.unit, r.close) for r in batch] == [("days", 1.5), ("months", 1.5)]
    stream = files.read_market_documents(spark, str(tmp_path), "stream")
    prices = stream.select(series.current_price(F.col("type"), F.col("price"), F.col("close")).alias("p"))
    assert sorted(r.p for r in prices.collect()) == [1.5, 7.0]


def test_coverage(spark):
    wanted = spark.createDataFrame([(date(2026, 8, 2),)], "trade_date date")
    stamp = "20260801T150000Z_20260802T150000Z"
    paths = spark.createDataFrame([(f"x/KRW-BTC/{stamp}_batch.json",), (f"x/KRW-BTC/{stamp}_stream.json",), (f"x/KRW-XRP/{stamp}_batch.json",)], "path string")
    out = {r.market_code: (r.batch_exists, r.stream_exists, r.all_exist) for r in files.dataset_coverage(wanted, files.stored_days(paths)).collect()}
    assert len(out) == 20
    assert out["KRW-BTC"] == (True, True, True) and out["KRW-XRP"] == (True, False, False) and out["KRW-ETH"] == (False, False, False)


def test_coverage_of_kst_names(spark):
    wanted = spark.createDataFrame([(date(2026, 8, 2),)], "trade_date date")
    names = [f"x/KRW-BTC/20260802T000000_20260803T000000_{kind}.json" for kind in ("batch", "stream")]
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    covered = files.dataset_coverage(wanted, files.stored_days(paths)).filter("all_exist").collect()
    assert [r.market_code for r in covered] == ["KRW-BTC"]


def test_written_folders_are_listed(spark, tmp_path):
    records, documents = str(tmp_path / "records"), str(tmp_path / "documents")
    files.write_order_records(rows(spark, ("KRW-BTC", KST_MIDNIGHT, "a"), ("KRW-XRP", KST_MIDNIGHT, "b")), records, reset=True)
    listed = files.list_files(spark, records, "*.parquet")
    day = spark.read.parquet(records).first()["trade_date"]
    assert [r.date for r in files.replay_dates(listed).collect()] == [str(day)]
    assert {tuple(r) for r in files.stored_days(listed).collect()} == {("KRW-BTC", day, "orders"), ("KRW-XRP", day, "orders")}
    for kind in ("batch", "stream"):
        files.write_documents(spark.createDataFrame([("KRW-BTC",)], "market string"), documents, kind, "2026-08-02")
    stored = files.stored_days(files.list_files(spark, documents, "*.json"))
    assert {tuple(r) for r in stored.collect()} == {("KRW-BTC", date(2026, 8, 2), kind) for kind in ("batch", "stream")}


def test_dated_tables_open_only_their_days(spark, tmp_path):
    root, schema = str(tmp_path / "ledger"), "order_id string, submitted_at timestamp"
    rows_ = spark.sql("select cast(id as string) as order_id, timestamp '2026-08-01' + make_interval(0, 0, 0, 0, cast(id as int)) as submitted_at from range(72)")
    tables.write_dated(rows_, root, "submitted_at")
    part = tables.read_dated(spark, root, schema, "submitted_at", "2026-08-02T06:00:00", "2026-08-03")
    assert sorted(int(r.order_id) for r in part.collect()) == list(range(30, 48))
    assert "utc_date" in part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_flush_keeps_markets_outside_the_dimension(spark, tmp_path):
    root = str(tmp_path / "records")
    one = rows(spark, ("KRW-BTC", KST_MIDNIGHT, "a"), ("KRW-NEW", KST_MIDNIGHT, "b"))
    assert files.flush_order_records(one, root, "r", 0) == {"KRW-BTC", "KRW-NEW"}
    assert spark.read.parquet(root).count() == 2
