"""Requests answered anew, against a plain walk, also where keys are cut into chunks."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidebook.operators import idempotency, ledger

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def plain(rows, seconds):
    last, out = {}, []
    for key, ts, number in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or ts - last[key] > timedelta(seconds=seconds):
            last[key] = ts
            out.append(number)
    return sorted(out)


def history(seed, n, gaps):
    draw, clock, rows = random.Random(seed), START, []
    for i in range(n):
        clock += timedelta(seconds=draw.choice(gaps))
        rows.append(("hot" if draw.random() < 0.7 else draw.choice(["a", "b", None]), clock, i))
    return rows


@pytest.mark.parametrize("gaps", [[0, 1, 7], [1, 30, 100], [40, 300, 5000]])
@pytest.mark.parametrize("hot_rows", [5, 60, 10**6])
def test_any_chunks_give_the_same(spark, gaps, hot_rows):
    rows = history(sum(gaps), 900, gaps)
    draw = random.Random(1)
    draw.shuffle(rows)
    requests = spark.createDataFrame([(k, t, i, "x") for k, t, i in rows], "k string, ts timestamp, id bigint, entry string").repartition(5)
    found = ledger.accepted_requests(requests, "k", "id", seconds=100, hot_rows=hot_rows)
    assert found.columns == requests.columns
    assert sorted(r.id for r in found.collect()) == plain(rows, 100)


def test_small_batches_keep_the_state(spark):
    rows = history(3, 500, [1, 30, 100])
    requests = spark.createDataFrame(rows, "k string, ts timestamp, id bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for hot_rows in (40, 10**6):
            found = ledger.accepted_requests(requests, "k", "id", seconds=100, hot_rows=hot_rows).collect()
            assert sorted(r.id for r in found) == plain(rows, 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_chunk_as_a_function():
    rng = np.random.default_rng(4)
    for _ in range(50):
        times = np.sort(rng.integers(1000, 1400, rng.integers(1, 60)))
        entry, out = idempotency.exits(times, 30)
        for last in [*range(900, int(times[0])), -(1 << 62)]:
            flags = np.zeros(len(times), bool)
            expected = idempotency._chain(times, last, 30, flags)
            at = np.searchsorted(entry, last + 30, side="right")
            assert (out[at] if at < len(entry) else last) == expected


def test_nothing_and_rows_without_times(spark):
    requests = spark.createDataFrame([("a", None, 1), ("a", START, 2)], "k string, ts timestamp, id bigint")
    assert [r.id for r in ledger.accepted_requests(requests, "k", "id").collect()] == [2]
    assert ledger.accepted_requests(requests.filter(F.lit(False)), "k", "id").count() == 0
