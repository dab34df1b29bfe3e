"""The given tables by name, with their columns read as declared."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
}
BATCH_BYTES = 4 << 20
_BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lets this session's Python workers take BATCH_BYTES at once, so that batches of long texts stay small in worker and JVM."""
    spark.conf.set(_BYTES_PER_BATCH, str(BATCH_BYTES))


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """Within it Python workers take batches of so many rows, whatever their bytes.

    For jobs over rows of a few numbers: there the number of rows bounds a batch, and Spark would spend most of such a
    job adding up the bytes of the batch so far, once a row.
    """
    before = spark.conf.get(_BYTES_PER_BATCH)
    spark.conf.set(_BYTES_PER_BATCH, str((1 << 31) - 1))
    try:
        yield
    finally:
        spark.conf.set(_BYTES_PER_BATCH, before)


def values(column: pa.Array, rows: int = 256) -> Iterator:
    """A column's Python values, made a few rows at a time so that long texts are not held twice."""
    for begin in range(0, len(column), rows):
        yield from column.slice(begin, rows).to_pylist()


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the largest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))).newbyteorder("<")).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    """The n numbers that narrow() packed."""
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)
