"""Timed headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tidebook.plans.catalog import QUERIES
from tidebook.session import local_session

HEADLINE = (
    "integrity", "overfilled", "sequence_reversals", "filled_totals", "order_summary", "summary_by_market",
    "latency_p99", "dashboard", "minute_series", "order_ledger", "dedup_executions", "resolve_mode", "trace_order",
    "book_at", "book_levels", "sweep_fill", "ohlcv", "hysteresis", "market_load", "asof_delta", "counter_rate",
    "price_history", "assignment_intervals", "run_sessions", "cancel_outcome", "validate_orders", "decode_orders",
    "replay_schedule", "replay_lineage", "insert_orders", "idempotent_orders", "order_ledger_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    names = list(QUERIES) if names == ["all"] else names
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["integrity"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        # The noop sink computes every row without moving it to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
