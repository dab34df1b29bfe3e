"""Ledger rules, and stream results equal to batch results."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from tidebook.operators import book, ledger

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
EVENT = (
    "type string, order_id string, market_code string, side string, price decimal(24,8), quantity decimal(24,8), mode string, "
    "submitted_at timestamp, client_request_id string, source_order_id string, canceled_at timestamp, offset bigint"
)
FILL = "buy_order_id string, sell_order_id string, quantity decimal(24,8), executed_at timestamp, offset bigint"


def new(oid, quantity, offset, side="BUY", price=100, market="M"):
    return ("NEW", oid, market, side, Decimal(price), Decimal(quantity), "REPLAY", START + timedelta(seconds=offset), f"c-{oid}", None, None, offset)


def cancel(oid, offset):
    return ("CANCEL", oid, "M", None, None, None, None, None, None, None, START + timedelta(seconds=offset), offset)


def fill(buy, sell, quantity, offset):
    return (buy, sell, Decimal(quantity), START + timedelta(seconds=offset), offset)


def state(df):
    return {r.order_id: (r.status, float(r.remaining_quantity), r.canceled_at is not None) for r in df.collect()}


@pytest.mark.parametrize("fills,cancels,want", [
    ([], [], ("ACCEPTED", 10, False)),
    ([4], [], ("PARTIALLY_FILLED", 6, False)),
    ([4, 6], [], ("FILLED", 0, False)),
    ([4], [1], ("CANCELED", 6, True)),
    ([4, 6], [1], ("FILLED", 0, False)),
    ([4, 8], [1, 2], ("FILLED", -2, False)),
    ([], [1], ("CANCELED", 10, True)),
])
def test_states(spark, fills, cancels, want):
    events = spark.createDataFrame([new("o", 10, 5), *[cancel("o", c) for c in cancels]], EVENT)
    done = spark.createDataFrame([fill("o", f"s{i}", q, 10 + i) for i, q in enumerate(fills)], FILL)
    assert state(ledger.order_ledger(events, done)) == {"o": want}


def test_fills_without_an_order_are_not_rows(spark):
    events = spark.createDataFrame([new("o", 1, 1)], EVENT)
    done = spark.createDataFrame([fill("o", "unseen", 1, 2)], FILL)
    assert set(state(ledger.order_ledger(events, done))) == {"o"}


def _random_history(seed):
    draw = random.Random(seed)
    events = [new(f"o{i}", draw.randrange(1, 20), i) for i in range(60)]
    events += [cancel(f"o{draw.randrange(60)}", 100 + i) for i in range(25)]
    pairs = {(draw.randrange(60), draw.randrange(60, 70)) for _ in range(120)}
    # Order 0 is met by far the most.
    pairs |= {(0, 60 + i) for i in range(10)}
    done = [fill(f"o{b}", f"o{s % 60}x" if s > 65 else f"o{s - 60}", draw.randrange(1, 5), 200 + i) for i, (b, s) in enumerate(sorted(pairs))]
    return events, done


@pytest.mark.parametrize("seed", [1, 2])
def test_arrival_order_and_redelivery_do_not_matter(spark, seed):
    events, done = _random_history(seed)
    expected = state(ledger.order_ledger(spark.createDataFrame(events, EVENT), spark.createDataFrame(done, FILL)))
    draw = random.Random(99)
    copies = [(b, s, q, t + timedelta(hours=1), o + 1000) for b, s, q, t, o in done]
    mixed_events, mixed = events + events, done + copies
    draw.shuffle(mixed_events)
    draw.shuffle(mixed)
    again = ledger.order_ledger(spark.createDataFrame(mixed_events, EVENT).repartition(5), spark.createDataFrame(mixed, FILL).repartition(7))
    assert state(again) == expected


def test_orders_of_unknown_markets_are_not_inserted(spark):
    schema = "order_id string, client_request_id string, market_code string, side string, mode string, price double, quantity double, submitted_at timestamp, offset bigint"
    batch = [(m, m, m, "BUY", "REPLAY", 1.0, 1.0, START, i) for i, m in enumerate(("KRW-BTC", "KRW-NONE"))]
    markets = spark.createDataFrame([("KRW-BTC",)], "market_code string")
    frame = spark.createDataFrame(batch, schema)
    assert [r.order_id for r in ledger.insert_orders(frame, frame.filter("false"), markets=markets).collect()] == ["KRW-BTC"]
    assert [r.order_id for r in ledger.insert_orders(frame, frame.filter("false")).collect()] == ["KRW-BTC"]
    assert ledger.insert_orders(frame, frame.filter("false"), any_market=True).count() == 2


def test_accepted_requests_against_brute_force(spark):
    draw = random.Random(8)
    rows, clock = [], START
    for i in range(400):
        clock += timedelta(seconds=draw.choice([1, 300, 1200, 3600, 9000]))
        rows.append(("hot" if draw.random() < 0.7 else f"k{draw.randrange(4)}", clock, i))
    last, want = {}, []
    for key, ts, i in rows:
        if key not in last or ts - last[key] > timedelta(hours=1):
            last[key] = ts
            want.append(i)
    requests = spark.createDataFrame(rows, "k string, ts timestamp, id bigint")
    got = ledger.accepted_requests(requests, "k", "id")
    assert sorted(r.id for r in got.collect()) == want


def test_insert_orders(spark):
    schema = "order_id string, client_request_id string, market_code string, side string, price decimal(24,8), quantity decimal(24,8), mode string, submitted_at timestamp, offset bigint"

    def row(oid, request, offset, side="BUY"):
        return (oid, request, "M", side, Decimal(1), Decimal(1), "REPLAY", START, offset)

    batch = [row("a", "ra", 1), row("a", "ra", 2), row("b", "ra", 3), row("c", "rc", 4), row("d", "rd", 5, "HOLD"), row("e", None, 6), row("f", None, 7), row("g", "stored", 8)]
    stored = spark.createDataFrame([("c", "other"), ("x", "stored"), ("y", None)], "order_id string, client_request_id string")
    got = ledger.insert_orders(spark.createDataFrame(batch, schema), stored, any_market=True)
    assert sorted((r.order_id, r.offset) for r in got.collect()) == [("a", 1), ("e", 6), ("f", 7)]


def test_offset_guard(spark):
    delivered = [("M", i, o) for i, o in enumerate([1, 2, 3, 2, 3, 4, 7, 5, 8])]
    out = ledger.offset_dedup(spark.createDataFrame(delivered, "market_code string, arrival bigint, offset bigint"), "arrival", chunk_rows=2)
    assert sorted(r.offset for r in out.collect()) == [1, 2, 3, 4, 7, 8]


def test_assignments(spark):
    def row(kind, engine, second, offset):
        return (kind, "M", engine, START + timedelta(seconds=second), offset)

    events = [row("ASSIGNED", "e1", 1, 1), row("RELEASED", "e2", 2, 2), row("ASSIGNED", "e2", 3, 3), row("RELEASED", "e1", 4, 4),
              row("RELEASED", "e2", 5, 5), row("ASSIGNED", "e1", 6, 6), row("ASSIGNED", "e1", 6, 7)]
    out = ledger.assignment_intervals(spark.createDataFrame(events, "type string, market_code string, engine_instance_id string, at timestamp, offset bigint"), chunk_rows=2)
    got = sorted((r.assigned_at.second, r.engine_instance_id, r.released_at and r.released_at.second) for r in out.collect())
    assert got == [(1, "e1", 3), (3, "e2", 5), (6, "e1", None)]
    engines = ledger.engines(out).collect()
    assert [(r.engine_instance_id, [m.market_code for m in r.markets]) for r in engines] == [("e1", ["M"])]


def test_cancel_outcomes(spark):
    placed = spark.createDataFrame([("a", Decimal(10)), ("b", Decimal(5))], "order_id string, quantity decimal(24,8)")
    done = spark.createDataFrame([fill("a", "b", 4, 10), fill("a", "z", 6, 30), fill("y", "b", 1, 10)], FILL)
    asked = [("a", 1, 20), ("a", 2, 25), ("a", 3, 40), ("b", 4, 5), ("b", 5, 50), ("q", 6, 1)]
    cancels = spark.createDataFrame([(o, c, START + timedelta(seconds=s)) for o, c, s in asked], "order_id string, cancel_id int, canceled_at timestamp")
    got = {r.cancel_id: (r.outcome, r.canceled_quantity and float(r.canceled_quantity)) for r in ledger.cancel_outcomes(cancels, placed, done, slice_seconds=7).collect()}
    assert got == {
        1: ("CANCELED", 6), 2: ("ALREADY_CANCELED", 6), 3: ("ORDER_ALREADY_FILLED", None), 4: ("CANCELED", 5), 5: ("ORDER_ALREADY_FILLED", None),
        6: ("ORDER_NOT_FOUND", None),
    }


def test_book_at(spark):
    events = [new("a", 5, 1), new("b", 5, 2), new("c", 5, 3, side="SELL", price=101), cancel("b", 4), new("late", 5, 50)]
    done = spark.createDataFrame([fill("a", "c", 2, 5), fill("a", "x", 3, 40)], FILL)
    moment = START + timedelta(seconds=20)
    out = book.book_snapshot(book.book_at(spark.createDataFrame(events, EVENT), done, moment)).collect()
    assert [(r.side, r.order_id, float(r.quantity)) for r in out] == [("BUY", "a", 3), ("SELL", "c", 3)]
