"""Which requests are answered anew, exactly, also for keys that hold a large part of all rows.

A request is answered anew if no request of its key was answered anew within the lifetime before it. The
answered requests of a key are a chain, each the first one past the lifetime of the one before.

Requests are walked in order of key and time, with one number to remember, the time last answered. A key
with more than HOT_ROWS requests is cut into chunks of time that are walked at once: each chunk first
becomes a function from the time last answered before it to the time last answered after it. Such a
function has a step for each request of the chunk's first lifetime. One pass over the steps of a key puts
the functions one after the other and so gives every chunk the time it begins with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: lifetime of an answer.
REQUEST_WINDOW = 3600
# Keys with more requests are cut into chunks.
HOT_ROWS = 4_000_000

_CHUNK, _CARRY, _KEY = "__chunk", "__carry", "__key"
# Times are in microseconds; this one lies before all lifetimes.
_NEVER = -(1 << 62)


def _groups(columns: list[pa.Array]) -> np.ndarray:
    """Where a new group begins in sorted columns, row 0 included."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = False
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(fresh)


def _micros(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _chain(times: np.ndarray, last: int, lifetime: int, answered: np.ndarray) -> int:
    """Mark the answered ones of sorted times in a row of flags; gives the time last answered."""
    at = int(np.searchsorted(times, last + lifetime, side="right"))
    while at < len(times):
        answered[at] = True
        last = int(times[at])
        at = int(np.searchsorted(times, last + lifetime, side="right"))
    return last


def exits(times: np.ndarray, lifetime: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk of sorted times as a function: its steps, and the time last answered after each.

    Whatever was last answered before the chunk, the first request past its lifetime is one of the steps,
    unless it outlives the whole chunk, which then changes nothing.
    """
    steps = np.unique(times)
    after = np.searchsorted(steps, steps + lifetime, side="right")
    out = steps.copy()
    # A step's exit is that of the step it leads to, which lies behind it: follow all of them at once.
    lead = np.where(after < len(steps), after, np.arange(len(steps)))
    while True:
        further = lead[lead]
        if (further == lead).all():
            break
        lead = further
    out = steps[lead]
    first = int(np.searchsorted(steps, steps[0] + lifetime, side="left")) + 1
    return steps[:first], out[:first]


def _functions(lifetime: int, key_type: pa.DataType | None = None):
    """Rows (key, chunk, ts) sorted by all three -> the steps of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        group: tuple | None = None

        def steps(of: tuple) -> pa.RecordBatch:
            entry, out = exits(np.concatenate(held), lifetime)
            key, chunk = of
            return pa.RecordBatch.from_arrays(
                [pa.array([key] * len(entry), key_kind), pa.array(np.full(len(entry), chunk)), pa.array(entry), pa.array(out)],
                names=[_KEY, _CHUNK, "entry", "out"],
            )

        key_kind = pa.string()
        for batch in batches:
            if not batch.num_rows:
                continue
            key_kind = batch.column(0).type
            starts = _groups([batch.column(0), batch.column(1)])
            times = _micros(batch.column(2))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                here = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
                if here != group and held:
                    yield steps(group)
                    held = []
                group = here
                held.append(times[a:b])
        if held:
            yield steps(group)

    return run


def _carries(lifetime: int):
    """Steps (key, chunk, entry, out) sorted by the first three -> the time each chunk begins with.

    Only the time last answered is held, so a key of any size passes through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = None
        chunk, last, begin, found = None, _NEVER, _NEVER, True
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _groups([batch.column(0), batch.column(1)])
            entries, outs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            keys, chunks, begins = [], [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                key_here, chunk_here = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
                if first or key_here != key:
                    last, chunk = _NEVER, None
                if first or chunk_here != chunk:
                    begin, found, first = last, False, False
                    keys.append(key_here)
                    chunks.append(chunk_here)
                    begins.append(begin)
                key, chunk = key_here, chunk_here
                if not found:
                    at = a + int(np.searchsorted(entries[a:b], begin + lifetime, side="right"))
                    if at < b:
                        last, found = int(outs[at]), True
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.column(0).type), pa.array(chunks, pa.int64()), pa.array(begins, pa.int64())], names=[_KEY, _CHUNK, _CARRY]
            )

    return run


def _answered(lifetime: int, key: int, ts: int, width: int):
    """Rows sorted by key, chunk and time -> the answered ones, without the helping columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: object = None
        last, first = _NEVER, True
        for batch in batches:
            if not batch.num_rows:
                continue
            of_chunk, carry = batch.column(width), batch.column(width + 1)
            starts = _groups([batch.column(key), of_chunk])
            ends = np.append(starts[1:], batch.num_rows)
            times = _micros(batch.column(ts))
            carries = carry.fill_null(_NEVER).to_numpy(zero_copy_only=False)
            answered = np.zeros(batch.num_rows, bool)
            # A group that fits into one lifetime and begins with nothing answers its first row alone.
            short = (times[ends - 1] - times[starts] <= lifetime) & (carries[starts] == _NEVER)
            answered[starts[short]] = True
            open_groups = set(np.flatnonzero(~short).tolist()) | {0, len(starts) - 1}
            for g in sorted(open_groups):
                a, b = int(starts[g]), int(ends[g])
                here = batch.column(key)[a].as_py(), of_chunk[a].as_py()
                if first or here != group:
                    last = int(carries[a])
                group, first = here, False
                answered[a:b] = False
                last = _chain(times[a:b], last, lifetime, answered[a:b])
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(answered)) for c in batch.columns[:width]], names=batch.schema.names[:width])

    return run


def accepted_requests(requests: DataFrame, key: str, id_column: str, seconds: int = REQUEST_WINDOW, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Requests answered anew: not within `seconds` after the last one answered anew for the key.

    `requests` holds (key, ts, unique id) and any other columns. Equal times are taken by id. Null keys are
    one key. Rows without a time are never answered.
    """
    lifetime = seconds * 1_000_000
    dated = requests.filter(F.col("ts").isNotNull())
    # Hot keys: how many rows each long slice has; a crowded slice is cut further.
    slice_of = F.floor(F.unix_seconds("ts") / F.lit(16 * seconds))
    width = F.lit(16 * lifetime)
    counted = dated.groupBy(F.struct(key).alias("__of"), slice_of.alias("__slice")).agg(F.count(F.lit(1)).alias("__rows"))
    total = F.sum("__rows").over(Window.partitionBy("__of"))
    hot = counted.withColumn("__total", total).filter(F.col("__total") > hot_rows).select(
        "__of", "__slice", F.ceil(F.col("__rows") * 16 / hot_rows).alias("__parts")
    )
    inside = F.unix_micros("ts") - F.col("__slice") * width
    chunk = F.col("__slice") * F.lit(1 << 24) + F.floor(inside * F.col("__parts") / width)
    marked = (
        dated.withColumns({"__of": F.struct(key), "__slice": slice_of}).join(hot, ["__of", "__slice"], "left")
        .withColumn(_CHUNK, F.when(F.col("__parts").isNotNull(), chunk).cast("bigint"))
        .select(*dated.columns, _CHUNK)
    )
    kind = dict(requests.dtypes)[key]
    crowded = marked.filter(F.col(_CHUNK).isNotNull()).select(F.col(key).alias(_KEY), _CHUNK, "ts")
    steps = (
        crowded.repartition(_KEY, _CHUNK).sortWithinPartitions(_KEY, _CHUNK, "ts")
        .mapInArrow(_functions(lifetime), f"{_KEY} {kind}, {_CHUNK} bigint, entry bigint, out bigint")
    )
    carries = (
        steps.repartition(_KEY).sortWithinPartitions(_KEY, _CHUNK, "entry")
        .mapInArrow(_carries(lifetime), f"{_KEY} {kind}, {_CHUNK} bigint, {_CARRY} bigint")
    )
    begun = marked.join(
        carries.withColumnRenamed(_CHUNK, "__chunk_of"), F.col(key).eqNullSafe(F.col(_KEY)) & (F.col(_CHUNK) == F.col("__chunk_of")), "left"
    ).select(*dated.columns, _CHUNK, _CARRY)
    walked = begun.repartition(key, _CHUNK).sortWithinPartitions(key, _CHUNK, "ts", id_column)
    places = dated.columns
    return walked.mapInArrow(_answered(lifetime, places.index(key), places.index("ts"), len(places)), requests.schema)
