"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the operators rely on: UTC wall clocks, runtime re-planning, splitting
# of skewed join partitions, and streaming state kept outside the heap.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# What a task reads of files or of a shuffle where it sorts its rows several times over.
_TASK_BYTES = str(8 << 20)


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def small_tasks(spark: SparkSession) -> None:
    """Lets this session's tasks read few bytes each, so that what they sort stays small however large a table is."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", _TASK_BYTES)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", _TASK_BYTES)


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidebook")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


_LOCAL_ROOT: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """A fresh path below the shared folder named by spark.checkpoint.dir.

    Only where the setting is absent (tests on one machine) is a temporary folder taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="tidebook-"))
        root = _LOCAL_ROOT[0]
    return f"{root.rstrip('/')}/tidebook/{uuid.uuid4().hex}"


def cut(df, spark: SparkSession):
    """Cut lineage through the shared folder, so that lost executors cost a re-read only."""
    path = work_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
