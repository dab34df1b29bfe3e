"""Running values along long ordered series.

A window over one market or one counter would put the whole series into one task, and a
market may hold a third of all rows. Here a series is cut into chunks by a column computed
from the row alone (a time slice, an offset range, a price band). Windows run inside one
chunk; one summary row per chunk, aggregated before its shuffle, carries the state over to
the later chunks. The result is the same as that of the plain window.

`scan` makes any number of running values in one go: with their own keys, forward and backward, and
sums of rises from row to row. However many there are, the input is read twice, once for the summaries and
once for the windows, and its rows are shuffled once. With time slices, the summaries also tell the series
long enough to be cut, and the crowded slices among theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"
KEY = "__key"
SLICE = "__slice"
BASE = "__base"
FINE = "__fine"
PART = "__part"

# A slice with more rows than this is cut further.
SLICE_ROWS = 4_000_000
# Parts of a crowded slice in a scan.
PARTS = 16


@dataclass(frozen=True)
class Slices:
    """Chunks of `seconds` by a time column for series of more than `limit` rows; a chunk with more is walked in PARTS parts."""

    ts: str
    seconds: int = 600
    limit: int = SLICE_ROWS


@dataclass(frozen=True)
class Running:
    """One running value of a scan.

    Kinds are sum, max, min, last (the newest non-null value) and climb (the sum of the rises from one
    row to the next, falls left out). With `backward` the series is walked from its end, so that last gives
    the next non-null value.
    """

    name: str
    kind: str
    value: Column
    keys: tuple[str, ...]
    include_current: bool = True
    backward: bool = False


def time_chunk(ts: Column, seconds: int = 600) -> Column:
    """Time slice of a row. Take narrower slices where one series has more rows per second."""
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def time_slices(df: DataFrame, keys: list[str], ts: str, seconds: int = 600, limit: int = SLICE_ROWS) -> DataFrame:
    """Add the chunk column SLICE: time slices, with crowded ones cut into finer slices.

    Rows are counted per series and slice first, merged map-side. A slice with more than
    `limit` rows is cut into 16 times as many parts as it has limits. The list of crowded
    slices has at most rows / limit entries; Spark broadcasts it if its size allows.
    """
    base = time_chunk(F.col(ts), seconds)
    counted = df.groupBy(*keys, base.alias("__base")).agg(F.count(F.lit(1)).alias("__rows"))
    crowded = counted.filter(F.col("__rows") > limit).select(
        *keys, "__base", (F.ceil(F.col("__rows") / limit) * 16).alias("__parts")
    )
    marked = df.withColumn("__base", base).join(crowded, [*keys, "__base"], "left")
    width = F.lit(seconds * 1_000_000)
    inside = F.unix_micros(ts) - F.col("__base") * width
    part = F.floor(inside * F.col("__parts") / width)
    chunk = F.col("__base") * F.lit(1 << 24) + F.coalesce(part, F.lit(0))
    return marked.withColumn(SLICE, chunk).select(*df.columns, SLICE)


def number_chunk(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width))


_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def _summaries(out: Running, where: Column) -> list[Column]:
    """What one chunk tells later ones: `__sum_`, and for last also where it stood, for climb its ends."""
    value = F.col(f"__in_{out.name}")
    if out.kind == "last":
        pick, edge = (F.min_by, F.min) if out.backward else (F.max_by, F.max)
        at = F.when(value.isNotNull(), where)
        return [pick(value, at).alias(f"__sum_{out.name}"), edge(at).alias(f"__at_{out.name}")]
    if out.kind == "climb":
        return [
            F.sum(f"__rise_{out.name}").alias(f"__sum_{out.name}"),
            F.min_by(value, F.when(value.isNotNull(), where)).alias(f"__first_{out.name}"),
            F.max_by(value, F.when(value.isNotNull(), where)).alias(f"__end_{out.name}"),
        ]
    return [_AGGREGATES[out.kind](value).alias(f"__sum_{out.name}")]


def _rise(value: Column, window) -> Column:
    return F.greatest(value - F.lag(value).over(window), F.lit(0))


def _series(out: Running) -> Column:
    return F.struct(*[F.col(f"{KEY}.{k}") for k in out.keys]) if out.keys else F.struct(F.lit(0))


def _carried(summaries: DataFrame, outputs: list[Running]) -> DataFrame:
    """Add the values with which each chunk begins, `__before_`, from all chunks before it."""
    for n, out in enumerate(outputs):
        place = F.col(CHUNK).desc() if out.backward else F.col(CHUNK).asc()
        before = Window.partitionBy(f"__series_{n}").orderBy(place).rangeBetween(Window.unboundedPreceding, -1)
        summaries = summaries.withColumn(f"__series_{n}", _series(out))
        total = F.col(f"__sum_{out.name}")
        if out.kind == "last":
            pick = F.min_by if out.backward else F.max_by
            found = pick(total, F.col(f"__at_{out.name}")).over(before)
        elif out.kind == "climb":
            # The step into a chunk rises from the end of the chunk before it.
            step = F.col(f"__first_{out.name}") - F.last(f"__end_{out.name}", ignorenulls=True).over(before)
            summaries = summaries.withColumn(f"__step_{out.name}", F.greatest(F.coalesce(step, F.lit(0)), F.lit(0)))
            step = F.col(f"__step_{out.name}")
            found = F.coalesce(F.sum(F.coalesce(total, F.lit(0)) + step).over(before), F.lit(0)) + step
        else:
            found = _AGGREGATES[out.kind](total).over(before)
        summaries = summaries.withColumn(f"__before_{out.name}", found)
    return summaries


def _over(out: Running, window) -> Column:
    value = F.col(f"__in_{out.name}")
    if out.kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return (F.sum(f"__rise_{out.name}") if out.kind == "climb" else _AGGREGATES[out.kind](value)).over(window)


def _combine(out: Running) -> Column:
    here, before = F.col(f"__here_{out.name}"), F.col(f"__before_{out.name}")
    if out.kind == "last":
        return F.coalesce(here, before)
    if out.kind == "climb":
        return F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
    if out.kind == "sum":
        return F.coalesce(here + before, here, before)
    return {"max": F.greatest, "min": F.least}[out.kind](here, before)


def scan(df: DataFrame, order: list[str], chunk: Column | Slices, outputs: list[Running]) -> DataFrame:
    """Add running values along `order`, each within its own keys.

    `chunk` is a number that never falls while `order` rises, or time slices. Null keys are one series of
    their own. Outputs may have different keys, all within those of the one with the most; then, and for
    climbs, `chunk` is a number. A climb starts at 0 and takes the current row in.
    """
    keys = max((out.keys for out in outputs), key=len)
    sliced = isinstance(chunk, Slices)
    if any(not set(out.keys) <= set(keys) for out in outputs):
        raise ValueError("the keys of all outputs must lie within those of one")
    if sliced and any(set(out.keys) != set(keys) for out in outputs):
        raise ValueError("time slices need the same keys for all outputs")
    climbs = [out for out in outputs if out.kind == "climb"]
    if any(set(out.keys) != set(keys) or not out.include_current or out.backward for out in climbs) or (sliced and climbs):
        raise ValueError("a climb goes forward along a numbered chunk, with all keys")
    if sliced:
        width = F.lit(chunk.seconds * 1_000_000)
        base = time_chunk(F.col(chunk.ts), chunk.seconds)
        fine = F.floor((F.unix_micros(chunk.ts) - base * width) * PARTS / width)
    else:
        base, fine = chunk, F.lit(0)
    # Structs of nulls are equal, unlike nulls, so one plain equi join serves all keys.
    staged = df.withColumns({
        KEY: F.struct(*keys) if keys else F.struct(F.lit(0)), BASE: base.cast("bigint"), FINE: fine.cast("bigint"),
        **{f"__in_{out.name}": out.value for out in outputs},
    })
    where = F.struct(*order) if len(order) > 1 else F.col(order[0])

    inner = staged
    if climbs:
        inside = Window.partitionBy(KEY, BASE).orderBy(*order)
        inner = staged.withColumns({f"__rise_{out.name}": _rise(F.col(f"__in_{out.name}"), inside) for out in climbs})
    summaries = inner.groupBy(KEY, BASE, FINE).agg(
        F.count(F.lit(1)).alias("__rows"), *[c for out in outputs for c in _summaries(out, where)]
    )
    befores = [F.col(f"__before_{out.name}") for out in outputs]
    if sliced:
        # A series of few rows is walked in one piece; only longer ones have rows on this side.
        summaries = summaries.withColumn("__total", F.sum("__rows").over(Window.partitionBy(KEY))).filter(F.col("__total") > chunk.limit)
    carried = _carried(summaries.withColumn(CHUNK, F.col(BASE) * PARTS + F.col(FINE)), outputs)
    if sliced:
        # A slice as a whole begins like its first part in the direction walked, a crowded one like each part.
        slice_ = Window.partitionBy(KEY, BASE)
        ends = slice_.orderBy(FINE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        crowded = F.sum("__rows").over(slice_) > chunk.limit
        carried = carried.withColumns({
            "__crowded": crowded, "__lowest": F.min(FINE).over(slice_),
            **{f"__whole_{out.name}": (F.last if out.backward else F.first)(f"__before_{out.name}").over(ends) for out in outputs},
        }).filter(F.col("__crowded") | (F.col(FINE) == F.col("__lowest"))).select(
            KEY, BASE, F.when(F.col("__crowded"), F.col(FINE)).otherwise(-1).alias(PART),
            *[F.when(F.col("__crowded"), c).otherwise(F.col(f"__whole_{out.name}")).alias(f"__before_{out.name}") for out, c in zip(outputs, befores, strict=True)],
        ).withColumnsRenamed({KEY: "__key_of", BASE: "__base_of"})
        met = (F.col(KEY) == F.col("__key_of")) & (F.col(BASE) == F.col("__base_of")) & F.col(PART).isin(-1, F.col(FINE))
        joined = staged.join(carried, met, "left").drop("__key_of")
        # Rows of short series have no part, and one chunk for all.
        joined = joined.withColumn(BASE, F.col("__base_of"))
    else:
        # Chunks that begin with nothing are left out; so a series within one chunk costs no row on this side.
        empty = " and ".join(f"__before_{out.name} is null" for out in outputs)
        joined = staged.join(carried.select(KEY, BASE, *befores).filter(f"not ({empty})"), [KEY, BASE], "left")
        joined = joined.withColumn(PART, F.lit(-1))
    if climbs:
        inside = Window.partitionBy(KEY, BASE, PART).orderBy(*order)
        joined = joined.withColumns({f"__rise_{out.name}": _rise(F.col(f"__in_{out.name}"), inside) for out in climbs})
    # The shortest keys come first: their partitions serve the longer ones as well.
    for out in sorted(outputs, key=lambda o: len(o.keys)):
        by = [KEY] if set(out.keys) == set(keys) else list(out.keys)
        inside = (
            Window.partitionBy(*by, BASE, PART)
            .orderBy(*[F.col(c).desc() if out.backward else F.col(c).asc() for c in order])
            .rowsBetween(Window.unboundedPreceding, 0 if out.include_current else -1)
        )
        joined = joined.withColumn(f"__here_{out.name}", _over(out, inside))
    return joined.select(*[F.col(c) for c in df.columns], *[_combine(out).alias(out.name) for out in outputs])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column | Slices,
    outputs: dict[str, tuple[str, Column]],
    include_current: bool = True,
    backward: bool = False,
) -> DataFrame:
    """Running values of one series and direction; `outputs` maps a new column to (kind, value)."""
    return scan(df, order, chunk, [Running(n, k, v, tuple(keys), include_current, backward) for n, (k, v) in outputs.items()])


def previous(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column | Slices, outputs: dict[str, Column]
) -> DataFrame:
    """Values of the preceding row of the series (null on its first row)."""
    packed = F.struct(*[v.alias(n) for n, v in outputs.items()])
    out = running(df, keys, order, chunk, {"__prev": ("last", packed)}, include_current=False)
    return out.select(*df.columns, *[F.col(f"__prev.{n}").alias(n) for n in outputs])
