"""Parquet tables read with declared schemas: no inference job, zone-less times read as UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.clock import moment, within

TABLES = {
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp"
    ),
    "events": (
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    ),
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return (
        spark.readStream.schema(TABLES[name])
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(folder)
    )


# ---- dated tables ------------------------------------------------------------------------

def write_dated(rows: DataFrame, root: str, ts: str, mode: str = "append") -> None:
    """Write ledger rows below utc_date=<day>, in time order within a file.

    Range partitions over (day, time) split a busy day into many files with narrow time
    ranges, so min/max statistics prune inside the day as well.
    """
    dated = rows.withColumn("utc_date", F.to_date(ts))
    (
        dated.repartitionByRange("utc_date", ts).sortWithinPartitions("utc_date", ts)
        .write.partitionBy("utc_date").mode(mode).option("partitionOverwriteMode", "dynamic").parquet(root)
    )


def read_dated(spark: SparkSession, root: str, schema: str, ts: str, start=None, end=None) -> DataFrame:
    """Rows of [start, end); other days are not opened."""
    rows = spark.read.schema(f"{schema}, utc_date date").parquet(root)
    if start is not None:
        rows = rows.filter(F.col("utc_date") >= F.lit(moment(start).date()))
    if end is not None:
        rows = rows.filter(F.col("utc_date") <= F.lit(moment(end).date()))
    return rows.filter(within(F.col(ts), start, end)).drop("utc_date")
