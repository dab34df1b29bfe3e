"""Chunked running values equal the plain window, also for one dominating key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.operators import series
from tidebook.operators.ordered import SLICE, number_chunk, previous, running, time_slices


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(7)
    data = []
    for n in range(3000):
        key = "hot" if draw.random() < 0.6 else f"k{draw.randrange(40)}"
        value = None if draw.random() < 0.3 else draw.randrange(-50, 50)
        data.append((key, n, value))
    draw.shuffle(data)
    return spark.createDataFrame(data, "k string, n bigint, v bigint").repartition(6).cache()


@pytest.mark.parametrize("width", [1, 7, 500, 10**6])
@pytest.mark.parametrize("current", [True, False])
@pytest.mark.parametrize("backward", [True, False])
def test_running(rows, width, current, backward):
    direction = F.col("n").desc() if backward else F.col("n")
    plain = Window.partitionBy("k").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    kinds = {"s": "sum", "a": "max", "i": "min", "l": "last"}
    out = running(
        rows, ["k"], ["n"], number_chunk(F.col("n"), width), {n: (k, F.col("v")) for n, k in kinds.items()}, current, backward
    )
    expected = rows.select(
        "*", F.sum("v").over(plain).alias("s"), F.max("v").over(plain).alias("a"), F.min("v").over(plain).alias("i"),
        F.last("v", ignorenulls=True).over(plain).alias("l"),
    )
    assert sorted(out.collect(), key=lambda r: r.n) == sorted(expected.collect(), key=lambda r: r.n)


def test_previous(rows):
    out = previous(rows, ["k"], ["n"], number_chunk(F.col("n"), 11), {"p": F.col("v"), "pn": F.col("n")})
    w = Window.partitionBy("k").orderBy("n")
    expected = rows.select("*", F.lag("v").over(w).alias("p"), F.lag("n").over(w).alias("pn"))
    assert sorted(out.collect(), key=lambda r: r.n) == sorted(expected.collect(), key=lambda r: r.n)


def test_crowded_slices_are_cut_in_order(rows):
    timed = rows.withColumn("ts", F.timestamp_millis(F.col("n") * 50))
    sliced = time_slices(timed, ["k"], "ts", seconds=20, limit=40)
    per_slice = sliced.groupBy("k", SLICE).count()
    assert per_slice.agg(F.max("count")).first()[0] <= 40
    back = Window.partitionBy("k").orderBy("n")
    falls = sliced.withColumn("fell", F.col(SLICE) < F.lag(SLICE).over(back)).filter("fell")
    assert falls.count() == 0


def test_crowded_slices_keep_results(rows):
    samples = rows.filter("v is not null").withColumnRenamed("v", "value").withColumn("ts", F.timestamp_millis(F.col("n") * 50))
    plain = series.hysteresis(samples, ["k"], ["ts", "n"], 30, -30).orderBy("n").collect()
    assert series.hysteresis(samples, ["k"], ["ts", "n"], 30, -30, slice_seconds=20, slice_rows=25).orderBy("n").collect() == plain
    wide = series.asof_delta(samples, ["k"], "n", seconds=3).orderBy("n").collect()
    assert series.asof_delta(samples, ["k"], "n", seconds=3, slice_seconds=20, slice_rows=25).orderBy("n").collect() == wide


def test_null_keys_carry_their_state(spark):
    rows = spark.createDataFrame([(None, n, 1 if n == 0 else None) for n in range(4)], "k string, n bigint, v bigint")
    out = running(rows, ["k"], ["n"], number_chunk(F.col("n"), 1), {"last": ("last", F.col("v"))})
    assert [r.last for r in out.orderBy("n").collect()] == [1, 1, 1, 1]
