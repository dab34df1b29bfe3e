"""How the rows of the registered streams arrive, on rows of the tests."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidebook.plans import catalog_ledger
from tidebook.plans.catalog import QUERIES
from tidebook.plans.registry import Views
from tidebook.sources.tables import TABLES

DAY = datetime(1996, 1, 1, tzinfo=timezone.utc)
SIZES = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]


@pytest.fixture
def sizes_kept(spark):
    before = {name: spark.conf.get(name) for name in SIZES}
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_a_ledger_stream_takes_its_input_in_many_tasks(spark, tmp_path, monkeypatch, sizes_kept):
    orders = [(k, k, "FOP"[k % 3], 10.0 * k, DAY, "1-URGENT") for k in range(1, 401)]
    lines = [(k, 1, 1, 1 + k % 3, float(1 + k % 7), 5.0, 0.0, 0.0, "A", "F", DAY + timedelta(days=k % 5)) for k in range(1, 401)]
    folder = tmp_path / "tables"
    # Copies of an execution's pair are filled once.
    for name, rows in (("orders", orders), ("lineitem", lines + lines[:50])):
        frame = spark.createDataFrame(rows, TABLES[name]).repartition(8)
        frame.write.option("parquet.block.size", 1 << 10).parquet(str(folder / f"{name}.parquet"))
    made = []

    def work_folder(_):
        made.append(tmp_path / f"work{len(made)}")
        return str(made[-1])

    monkeypatch.setattr(catalog_ledger, "work_folder", work_folder)
    found = QUERIES["order_ledger_stream"](spark, str(folder)).collect()
    topics = [list((root / "in").rglob("part-*.parquet")) for root in made if (root / "in").exists()]
    assert len(topics) == 2
    for files in topics:
        # Both micro-batches of a topic, neither of them one task's file.
        assert len(files) > 4
    batch = QUERIES["order_ledger"](spark, str(folder))
    same = [c for c in batch.columns if c in found[0].asDict()]
    key = lambda r: tuple(str(r[c]) for c in same)
    assert sorted(map(key, found)) == sorted(map(key, batch.collect())) and len(found) == 400


def test_each_number_is_one_micro_batch(spark, tmp_path, monkeypatch):
    made = []

    def work_folder(_):
        made.append(str(tmp_path / f"work{len(made)}"))
        return made[-1]

    monkeypatch.setattr(catalog_ledger, "work_folder", work_folder)
    rows = spark.range(0, 300, 1, 8).withColumn("at", F.when(F.col("id") % 10 != 0, F.col("id") % 3))
    seen = []

    def run(arriving):
        step = lambda batch, number: seen.append({(r["at"], r["count"]) for r in batch.groupBy("at").count().collect()})
        return arriving.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()

    catalog_ledger._drained(Views(spark, str(tmp_path)), run, (rows, F.col("at")))
    assert seen == [{(0, 90)}, {(1, 90)}, {(2, 90)}, {(None, 30)}]
