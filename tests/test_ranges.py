"""Registered queries over time ranges, on rows of the test."""

from datetime import datetime, timezone

from tidebook.plans.catalog import QUERIES
from tidebook.sources.tables import TABLES

SINCE = 1700000500000  # the range has no upper end


def test_range_filter_reaches_the_last_record(spark, tmp_path):
    day = datetime(1996, 1, 1, tzinfo=timezone.utc)
    # A record's time is 1700000000000 + 700 * order key.
    keys = [1, 714, 715, 4285, 4290, 60_000, 6_000_000_000]
    orders = spark.createDataFrame([(k, 0, "O", 1.0, day, "1-URGENT") for k in keys], TABLES["orders"])
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["range_filter"](spark, str(tmp_path)).collect()
    assert {r.order_id for r in found} == {f"ord_{k}" for k in keys if 1700000000000 + 700 * k >= SINCE}
    assert "ord_6000000000" in {r.order_id for r in found}
