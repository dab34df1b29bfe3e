"""Physical plans: no pairwise joins, filters and columns reach the scan."""

import re

import pytest
from pyspark.sql import functions as F

from tidebook.functions.clock import within
from tidebook.operators import integrity, orders, series
from tidebook.plans.catalog import QUERIES
from tidebook.plans.fixtures import view
from tidebook.sources.tables import read_table

# Streams run when they are built.
EAGER = {"archive_stream", "live_counts", "ingest_stream", "order_ledger_stream", "accept_stream", "run_sessions_stream"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_no_pairwise_join(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert not re.search("CartesianProduct|NestedLoopJoin", text)
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_pushdown_and_pruning(spark, small):
    table = read_table(spark, small, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("submitted_at"), F.col("o_orderstatus").alias("status")
    )
    text = plan(table.filter(within(F.col("submitted_at"), "1996-01-01", "1997-01-01")).agg(F.count("*")))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderd" in text
    assert "ReadSchema: struct<o_orderdate:timestamp>" in text


def test_top_rows_are_taken_not_sorted(spark, small):
    rows = read_table(spark, small, "events").withColumnsRenamed({"event_type": "type"})
    assert "TakeOrderedAndProject" in plan(series.latest_events(rows))


def test_history_limit_before_the_shuffle(spark, small):
    rows = read_table(spark, small, "events").withColumnsRenamed({"event_type": "market_code", "value": "price"})
    assert "WindowGroupLimit" in plan(series.price_history(rows, ["ts", "event_id"]))


def test_market_filter_is_broadcast(spark, small):
    rows = read_table(spark, small, "events").withColumnsRenamed({"event_type": "market_code"})
    assert "BroadcastHashJoin" in plan(orders.market_semi(rows))


def test_overfilled_sums_before_the_join(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        executions = read_table(spark, small, "lineitem").select(
            F.col("l_orderkey").alias("buy_order_id"), (F.col("l_orderkey") + 1).alias("sell_order_id"), F.col("l_quantity").alias("quantity")
        )
        placed = read_table(spark, small, "orders").select(F.col("o_orderkey").alias("order_id"), F.lit(1.0).alias("quantity"))
        text = plan(integrity.overfilled_orders(placed, executions))
        assert text.index("SortMergeJoin") < text.index("HashAggregate")
        assert text.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name,source", [
    ("replay_schedule", "v_record"), ("assignment_intervals", "v_assign"), ("hysteresis", "v_sample"), ("asof_delta", "v_sample"),
    ("counter_rate", "v_counter"), ("offset_dedup", "v_delivered"),
])
def test_running_values_read_their_input_twice(spark, small, name, source):
    once = plan(view(spark, small, source)).count("FileScan")
    assert plan(QUERIES[name](spark, small)).count("FileScan") <= 2 * once
