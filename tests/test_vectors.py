"""Small literal cases per operator."""

from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidebook.functions import clock, ticks
from tidebook.operators import book, integrity, ledger, metrics, orders, replay, runs, series
from tidebook.sources import decode


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def values(df, column):
    return [r[column] for r in df.collect()]


# ---- decoding ----

def test_decode_orders(spark):
    bodies = [
        '{"type":"NEW","orderId":"ord_1","market":"KRW-BTC","side":"BUY","price":"1.5","quantity":"2","mode":"PAPER_TRADING","acceptedAt":"2026-08-01T00:00:00.120Z"}',
        '{"type":"CANCEL","orderId":"ord_1","market":"KRW-BTC","canceledAt":"2026-08-01T00:00:01.000Z"}',
        '{"type":"WEIRD","orderId":"ord_1"}', "not json", '{"type":"NEW","price":5}', '{"type":"NEW"', "", None, "null", '"NEW"',
        '{"type":"NEW","orderId":"say \\"price\\": 5"}',
    ]
    raw = spark.createDataFrame([(b,) for b in bodies], "body string")
    out = decode.decode_orders(raw)
    assert [r.body for r in out.filter("rejected").collect()] == bodies[2:10]
    assert decode.rejects(out).count() == 8
    good = decode.order_rows(out).collect()
    assert good[0].price == Decimal("1.5") and good[0].submitted_at == datetime(2026, 8, 1, 0, 0, 0, 120000)
    assert good[1].type == "CANCEL" and good[1].side is None and good[1].mode is None
    assert good[1].canceled_at == datetime(2026, 8, 1, 0, 0, 1)
    assert good[2].order_id == 'say "price": 5'


def test_only_top_level_fields_must_be_texts(spark):
    bodies = [
        '{"type":"NEW","orderId":"1","meta":{"price":1}}', '{"type":"NEW","orderId":"2","extra":[{"market":3}]}',
        '{"type":"NEW","orderId":"3","price":null}', '{"type":"NEW","orderId":"4","price":{"a":1}}',
        '{"type":"NEW","orderId":"5","meta":{"price":"1"},"market":true}',
    ]
    out = decode.decode_orders(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert [r.orderId for r in out.filter("not rejected").collect()] == ["1", "2", "3"]


def test_a_pod_counts_once_in_a_step(spark):
    samples = [("w", "p", at("2026-08-01T00:00:00") + timedelta(seconds=10 * i), float(i)) for i in range(20)]
    samples.append(("w", "q", at("2026-08-01T00:00:00"), 5.0))
    frame = spark.createDataFrame(samples, "workload string, pod string, ts timestamp, value double")
    assert [(r.total_avg, r.total_max) for r in metrics.resource_hourly(frame).collect()] == [(24.0, 24.0)]


def test_decode_executions_and_assignments(spark):
    raw = spark.createDataFrame([('{"market":"A","buyOrderId":"1","sellOrderId":"2","price":"3","quantity":"0.1"}',), ("[]",)], "body string")
    rows = decode.execution_rows(decode.decode_executions(raw), F.lit(at("2026-01-01"))).collect()
    assert [(r.buy_order_id, r.quantity) for r in rows] == [("1", Decimal("0.1"))]
    raw = spark.createDataFrame([('{"type":"ASSIGNED","market":"A","engineInstanceId":"e","at":"2026-01-01T00:00:00.000Z"}',), ('{"type":"X"}',)], "body string")
    assert [r.engine_instance_id for r in decode.assignment_rows(decode.decode_assignments(raw)).collect()] == ["e"]


# ---- validation and ticks ----

@pytest.mark.parametrize("market,side,price,quantity,code", [
    ("KRW-BTC", "BUY", "71500000", "0.5", None),
    ("KRW-BTC", "BUY", "71500123", "0.5", "INVALID_PRICE_UNIT"),
    ("KRW-BTC", "BUY", "0", "0.5", "INVALID_PRICE"),
    ("KRW-BTC", "BUY", "abc", "0.5", "INVALID_PRICE"),
    ("KRW-BTC", "BUY", "1e400", "0.5", "INVALID_PRICE"),
    ("KRW-BTC", "BUY", "1d", "0.5", "INVALID_PRICE"),
    ("KRW-BTC", "BUY", "NaN", "0.5", "INVALID_PRICE_UNIT"),
    ("KRW-BTC", "BUY", "inf", "0.5", "INVALID_PRICE_UNIT"),
    ("KRW-BTC", "BUY", None, "0.5", "INVALID_PRICE"),
    ("KRW-BTC", "SELL", "71500000", "0", "INVALID_QUANTITY"),
    ("KRW-BTC", "SELL", "71500000", "-1", "INVALID_QUANTITY"),
    ("KRW-BTC", "HOLD", "abc", "-1", "INVALID_SIDE"),
    ("KRW-NONE", "HOLD", "abc", "-1", "INVALID_MARKET"),
    (None, "BUY", "1", "1", "INVALID_MARKET"),
])
def test_validate(spark, market, side, price, quantity, code):
    row = spark.createDataFrame([(market, side, price, quantity)], "market_code string, side string, price string, quantity string")
    assert values(orders.validate_orders(row), "error_code") == [code]


def test_split_valid(spark):
    rows = spark.createDataFrame([("KRW-BTC", "BUY", "1", "1"), ("X", "BUY", "1", "1")], "market_code string, side string, price string, quantity string")
    accepted, rejected = orders.split_valid(rows)
    assert accepted.columns == rows.columns and accepted.count() == 1
    assert values(rejected, "error_code") == ["INVALID_MARKET"]


def test_on_tick(spark):
    cases = [(632.7, True), (632.73, False), (91000000.0, True), (91000123.0, False), (1234500.0, True), (1234567.0, False)]
    out = ticks.with_ticks(spark.createDataFrame(cases, "price double, want boolean"), "price")
    assert out.filter(ticks.on_tick(F.col("ratio")) != F.col("want")).count() == 0


def test_price_text(spark):
    cases = [
        (632.732, "632.7"), (635.268, "635.3"), (634.0, "634.0"), (91000123.0, "91000000"), (1234567.0, "1234500"),
        (72345.0, "72350"), (123456.7, "123450"), (7.1234, "7.123"), (0.05678, "0.05678"),
    ]
    out = ticks.with_price_text(spark.createDataFrame(cases, "price double, want string"), "price")
    assert [(r.price, r.price_text) for r in out.collect()] == cases


def test_default_mode(spark):
    rows = spark.createDataFrame([("REPLAY",), ("PAPER_TRADING",), ("x",), (None,)], "m string")
    assert values(rows.select(orders.default_mode(F.col("m")).alias("m")), "m") == ["REPLAY"] + ["PAPER_TRADING"] * 3


def test_book_price_is_cut(spark):
    row = spark.sql("select cast('1.123456789' as decimal(38,18)) as p")
    assert values(row.select(ticks.book_price(F.col("p")).alias("p")), "p") == [Decimal("1.12345678")]


# ---- clock ----

def test_clock(spark):
    assert clock.kst_day("2026-08-02") == (at("2026-08-01T15:00:00"), at("2026-08-02T15:00:00"))
    row = spark.sql("select timestamp '2026-08-01 15:00:00' as ts").select(
        clock.kst_date(F.col("ts")).cast("string").alias("d"), clock.iso(F.col("ts")).alias("i"), clock.kst_hour(F.col("ts")).alias("h")
    ).first()
    assert tuple(row) == ("2026-08-02", "2026-08-01T15:00:00.000Z", "2026-08-02 00:00 KST")
    bad = spark.createDataFrame([("2026-08-01",), ("x",)], "t string").select(clock.parse_iso(F.col("t")).alias("t"))
    assert values(bad, "t") == [None, None]


# ---- latency ----

@pytest.mark.parametrize("samples,want", [([], 0), ([42], 42), ([300, 100, 200], 200), (list(range(1, 101)), 99), ([5, 5, 5, 1], 5)])
def test_rank_value(spark, samples, want):
    rows = spark.createDataFrame([(s,) for s in samples], "v bigint")
    assert tuple(metrics.value_at_rank(rows, "v", 0.99).first()) == (want, len(samples))


def test_rank_value_wide_range(spark):
    import random

    draw = random.Random(3)
    data = [draw.randrange(-(10**15), 10**15) for _ in range(5000)] + [7] * 2000
    got = metrics.value_at_rank(spark.createDataFrame([(d,) for d in data], "v bigint"), "v", 0.99).first()
    assert got.value == sorted(data)[int(0.99 * len(data)) - 1]


# ---- series ----

def _stamped(spark, texts, name):
    return spark.createDataFrame([(at(t),) for t in texts], f"{name} timestamp")


def test_throughput_widths_and_checks(spark):
    assert [metrics.bucket_width(timedelta(minutes=m)) for m in (30, 31, 180, 181, 720, 721)] == [60, 300, 300, 900, 900, 1800]
    empty = _stamped(spark, ["2026-01-01T00:00:00"], "submitted_at")
    with pytest.raises(ValueError):
        metrics.throughput_series(empty, empty, "2026-01-01", "2026-01-01")
    with pytest.raises(ValueError):
        metrics.throughput_series(empty, empty, "2026-01-01", "2026-01-02T00:00:01")


def test_throughput_series_end(spark):
    placed = _stamped(spark, ["2026-01-01T00:00:10", "2026-01-01T00:01:59", "2026-01-01T00:02:00.200"], "submitted_at")
    done = _stamped(spark, ["2026-01-01T00:01:00"], "executed_at")
    # The end second starts a bucket of its own, which is left out.
    out = metrics.throughput_series(placed, done, "2026-01-01T00:00:05", "2026-01-01T00:02:00.500").orderBy("bucket_start").collect()
    assert [tuple(r) for r in out] == [("2026-01-01T00:00:00Z", 1, 0), ("2026-01-01T00:01:00Z", 1, 1)]


def test_dropped_series_includes_end(spark):
    lost = _stamped(spark, ["2026-01-01T00:00:10", "2026-01-01T00:02:30"], "ts")
    out = metrics.dropped_series(lost, "2026-01-01T00:00:00", "2026-01-01T00:02:00").orderBy("bucket_start").collect()
    assert [r.dropped for r in out] == [1, 0, 1]


def test_hysteresis_band(spark):
    lags = [0, 400, 1999, 2000, 1000, 401, 400, 1999, 2500, 399]
    rows = spark.createDataFrame([("r", at("2026-01-01") + timedelta(seconds=i), v) for i, v in enumerate(lags)], "k string, ts timestamp, value bigint")
    out = series.hysteresis(rows, ["k"], ["ts"], 2000, 400, slice_seconds=3).orderBy("ts")
    assert values(out, "active") == [False, False, False, True, True, True, False, False, True, False]


def test_price_history_keeps_the_last(spark):
    rows = spark.createDataFrame([("A", i, float(i)) for i in range(40)] + [("B", 1, 5.0)], "market_code string, n int, price double")
    out = series.price_history(rows, ["n"]).collect()
    assert out[0].prices == [float(i) for i in range(10, 40)] and out[0].price == 39.0
    assert out[1].prices == [5.0]


def test_stream_merge(spark):
    candle = "market_code string, start bigint, open double, high double, low double, close double, volume double"
    seconds = spark.createDataFrame([("A", 300, 1.0, 1.0, 1.0, 1.0, 1.0)], candle)
    minutes = spark.createDataFrame([("A", 100, 1.0, 1.0, 1.0, 1.0, 1.0)], candle)
    trades = spark.createDataFrame(
        [("A", datetime.fromtimestamp(200, timezone.utc), 2.0, 1.0, "BID"), ("A", datetime.fromtimestamp(400, timezone.utc), 2.0, 1.0, "ASK")],
        "market_code string, ts timestamp, price double, volume double, ask_bid string",
    )
    out = series.in_time_order(series.build_stream(seconds, minutes, trades)).collect()
    assert [(r.ts, r.type, r.side) for r in out] == [
        (100000, "candle_minute", None), (200000, "trade_tick", "BUY"), (300000, "candle_second", None), (400000, "trade_tick", "SELL")
    ]


def test_restarts(spark):
    rows = spark.createDataFrame([("p0", 1, 0.0), ("p1", 1, 9.0), ("p1", 2, 3.0), ("p2", 1, 5.0)], "pod string, ts int, value double")
    out = metrics.restarts_top(rows, ["pod"], "pod").collect()
    assert [tuple(r) for r in out] == [("p2", 5), ("p1", 3)]


def test_counter_rate_resets(spark):
    start = at("2026-01-01")
    rows = spark.createDataFrame([("c", start + timedelta(seconds=10 * i), v) for i, v in enumerate([10.0, 40.0, 5.0, 11.0])], "c string, ts timestamp, value double")
    assert values(metrics.counter_rate(rows, ["c"], ["ts"]), "rate") == [(30 + 5 + 6) / 60]


# ---- replay ----

def test_replay_preview(spark):
    rows = spark.createDataFrame([("A", t) for t in (1000, 6000, 11000)] + [("B", 2000), ("B", 2500)], "market_code string, ts bigint")
    assert tuple(replay.replay_preview(rows).first()) == (5, 2, 20, 10.0)
    assert tuple(replay.replay_preview(rows.limit(0)).first()) == (0, 0, 20, 0.0)


def test_replay_schedule_ignores_backward_gaps(spark):
    rows = spark.createDataFrame([("A", i, t) for i, t in enumerate([1000, 3000, 2000, 5000])], "market_code string, position bigint, ts bigint")
    out = replay.replay_schedule(rows, 2, chunk_rows=2).orderBy("position")
    assert values(out, "planned_seconds") == [0.0, 1.0, 1.0, 2.5]


@pytest.mark.parametrize("bounds,want", [((0, 0), [1, 2, 3]), ((2, 0), [2, 3]), ((0, 2), [1, 2]), ((2, 2), [2])])
def test_range_filter(spark, bounds, want):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "ts bigint")
    assert sorted(values(series.range_filter(rows, *bounds), "ts")) == want


def test_shard_slice(spark):
    rows = spark.createDataFrame([("KRW-USDT",), ("KRW-BTC",), ("KRW-ONDO",), ("X",)], "market_code string")
    assert sorted(values(replay.shard_slice(rows, 0, 4), "market_code")) == ["KRW-ONDO", "KRW-USDT"]


# ---- modes, runs ----

def test_resolve_mode(spark):
    known = spark.createDataFrame([("p", "PAPER_TRADING"), ("r", "REPLAY"), ("q", "PAPER_TRADING")], "order_id string, mode string")
    pairs = [("p", "q"), ("p", "r"), ("p", "-"), ("-", "r"), ("-", "+")]
    rows = spark.createDataFrame(pairs, "buy_order_id string, sell_order_id string")
    got = {(r.buy_order_id, r.sell_order_id): (r.mode, r.buy_found, r.sell_found, r.mode_mismatched) for r in ledger.resolve_mode(rows, known).collect()}
    assert [got[p] for p in pairs] == [
        ("PAPER_TRADING", True, True, False), ("PAPER_TRADING", True, True, True), ("PAPER_TRADING", True, False, False),
        ("REPLAY", False, True, False), (None, False, False, False),
    ]


def test_sessions(spark):
    start = at("2026-01-01")
    beats = [("r1", s) for s in (0, 30, 119, 238, 358, 500)] + [("r2", 0), ("r3", 450)]
    rows = spark.createDataFrame([(r, start + timedelta(seconds=s)) for r, s in beats], "run_id string, ts timestamp")
    done = spark.createDataFrame([("r2", start + timedelta(seconds=60), "COMPLETED", "fine")], "run_id string, at timestamp, status string, message string")
    out = runs.run_sessions(rows, done, start + timedelta(seconds=560)).orderBy("run_id", "started_at").collect()
    # 238 -> 358 is exactly the lifetime, so the run had expired.
    assert [(r.run_id, r.beats, r.status) for r in out] == [
        ("r1", 4, "FAILED"), ("r1", 1, "FAILED"), ("r1", 1, "IN_PROGRESS"), ("r2", 1, "COMPLETED"), ("r3", 1, "IN_PROGRESS")
    ]
    assert out[0].message == runs.EXPIRED_NOTE and out[3].ended_at == datetime(2026, 1, 1, 0, 1)


def test_append_note(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a",)], "m string")
    assert values(rows.select(runs.append_note(F.col("m"), F.lit("n")).alias("m")), "m") == ["n", "n", "a | n"]


# ---- integrity ----

def test_order_loss_without_plan(spark):
    rows = spark.createDataFrame([("REPLAY", at("2026-01-01"))], "mode string, submitted_at timestamp")
    assert integrity.order_loss(rows, None, "REPLAY", "2025-01-01", "2027-01-01").first().order_loss is None


def test_self_trade_is_traced_once(spark):
    placed = spark.createDataFrame([(1,), (2,)], "order_id bigint")
    done = spark.createDataFrame([(1, 1, at("2026-01-01"), Decimal(1))], "buy_order_id bigint, sell_order_id bigint, executed_at timestamp, quantity decimal(24,8)")
    assert ledger.trace_orders(placed, done).count() == 2
    assert ledger.trace_orders(placed, done, order_id=1).count() == 1


# ---- books ----

BOOK = "market_code string, side string, order_id string, price decimal(24,8), quantity decimal(24,8), offset bigint"
ORDER = "market_code string, side string, order_id string, price decimal(24,8), quantity decimal(24,8)"


def sweep(spark, resting, incoming):
    def dec(rows):
        return [tuple(Decimal(str(x)) if i in (3, 4) else x for i, x in enumerate(r)) for r in rows]

    out = book.sweep_fill(spark.createDataFrame(dec(resting), BOOK), spark.createDataFrame(dec(incoming), ORDER))
    return sorted((r.buy_order_id, r.sell_order_id, float(r.price), float(r.quantity)) for r in out.collect())


def test_sweep(spark):
    ask = [("M", "SELL", "s1", 100, 1, 1)]
    assert sweep(spark, ask, [("M", "BUY", "b", 99, 1)]) == []
    assert sweep(spark, ask, [("M", "BUY", "b", 100, 1)]) == [("b", "s1", 100, 1)]
    asks = [("M", "SELL", "s3", 101, 5, 3), ("M", "SELL", "s2", 100, 2, 2), ("M", "SELL", "s1", 100, 1, 1), ("M", "SELL", "s4", 110, 9, 4)]
    # Best price first, oldest first, at the resting price; the limit stops the sweep.
    assert sweep(spark, asks, [("M", "BUY", "b", 105, "3.5")]) == [("b", "s1", 100, 1), ("b", "s2", 100, 2), ("b", "s3", 101, 0.5)]
    assert sweep(spark, asks, [("M", "BUY", "b", 105, 50)]) == [("b", "s1", 100, 1), ("b", "s2", 100, 2), ("b", "s3", 101, 5)]
    bids = [("M", "BUY", "b1", 99, 1, 1), ("M", "BUY", "b2", 100, 1, 2), ("N", "BUY", "b3", 100, 1, 3)]
    assert sweep(spark, bids, [("M", "SELL", "s", 99, 2), ("M", "SELL", "t", 100, 2)]) == [("b1", "s", 99, 1), ("b2", "s", 100, 1), ("b2", "t", 100, 1)]


def test_sweep_against_brute_force(spark):
    import random

    draw = random.Random(11)
    resting = [("M", draw.choice(["BUY", "SELL"]), f"r{i}", draw.randrange(90, 111), draw.randrange(1, 9), i) for i in range(150)]
    incoming = [("M", draw.choice(["BUY", "SELL"]), f"i{i}", draw.randrange(85, 116), draw.randrange(1, 400)) for i in range(60)]
    want = []
    for market, side, oid, limit, quantity in incoming:
        queue = [r for r in resting if r[1] != side and (r[3] <= limit if side == "BUY" else r[3] >= limit)]
        queue.sort(key=lambda r: (r[3] if side == "BUY" else -r[3], r[5]))
        for r in queue:
            done = min(quantity, r[4])
            if done <= 0:
                break
            quantity -= done
            want.append((oid, r[2], float(r[3]), float(done)) if side == "BUY" else (r[2], oid, float(r[3]), float(done)))
    assert sweep(spark, resting, incoming) == sorted(want)


def test_book_levels_skip_unreadable(spark):
    rows = [("M", "SELL", "10", "1"), ("M", "SELL", "10", "2"), ("M", "SELL", "11", "oops"), ("M", "SELL", "12", "4"), ("M", "BUY", "9", "1"), ("M", "BUY", "8", "1")]
    out = spark.createDataFrame(rows, "market_code string, side string, price string, quantity string").withColumn("price", F.col("price").cast("decimal(24,8)"))
    got = [(r.side, float(r.price), float(r.quantity)) for r in book.book_levels(out, 2).orderBy("side", "level").collect()]
    assert got == [("BUY", 9, 1), ("BUY", 8, 1), ("SELL", 10, 3), ("SELL", 12, 4)]
    with pytest.raises(ValueError):
        book.book_levels(out, 0)
