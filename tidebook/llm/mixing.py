"""Mixing sources to target weights by entropy balancing.

Documents get rates that stay as close as possible to 1 (in relative entropy, counted by token, between
0 and a cap) while each source's expected tokens equal its target. The convex dual has one multiplier
per source: a document's rate is the logistic tilt cap / (1 + (cap - 1) exp(-multiplier)). The dual's
gradient and curvature are sums over documents, which one aggregation gives per source; Newton steps on
them run inside Spark for all sources at once. Rates then become whole copies: in each source, document
sizes are served from large to small and every size carries the rounding error of the larger ones, so a
source misses its target by about half its smallest document.

Null and empty texts have size 0 and are kept once. A null source is a source of its own, last in order.
Repeated rows are counted and taken each. Sources without any words have target 0. Empty tables give
empty results. Extra columns do not matter; working columns start with "__".

Only DataFrame and SQL functions are used. What a single task sees whole: one narrow row per source for
the targets, and one row per (source, size) of one source for the rounding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.session import cut

WEIGHTS = (5, 2, 1)
CAP = 3
NEWTON_STEPS = 60
# Documents of one source and size are dealt to buckets of about so many before they are numbered.
BUCKET_ROWS = 20_000
BLOCK_SIZES = 128


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """__source, source_size, target: shares of all tokens by weight, none above cap times its source's size.

    The excess of capped sources goes to the others by weight. So every target is the smaller of its cap and
    its weight times one common level. Sources reach their caps in the order of size over weight, hence the
    level follows from running sums in that order: it is the one at the first source that stays below its cap.
    """
    by_source = sizes.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = by_source.withColumn("__weight", weight).withColumn("__cap", (F.col("source_size") * cap).cast("double"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy(F.col("__cap") / F.col("__weight"), F.col("__source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        / (F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0)))
    )
    levels = weighed.withColumn("__level", level).withColumn("__free", F.col("__cap") >= F.col("__level") * F.col("__weight"))
    first = F.min(F.when(F.col("__free"), F.struct((F.col("__cap") / F.col("__weight")).alias("at"), F.col("__level").alias("level"))))
    common = first.over(everything)["level"]
    return levels.select(
        "__source", "source_size", F.least("__cap", F.coalesce(F.col("__weight") * common, F.col("__cap"))).alias("target")
    )


def tilt(multiplier: Column, cap: int) -> Column:
    return F.lit(float(cap)) / (1 + (cap - 1) * F.exp(-multiplier))


def multipliers(targets: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds __rate: the tilted rate at the dual's optimum, by damped Newton steps from multiplier 0."""
    size, target = F.col("source_size").cast("double"), F.col("target")

    def step(m: Column, _: Column) -> Column:
        rate = tilt(m, cap)
        # Gradient and curvature of the dual, summed over the source's documents.
        gradient = target - size * rate
        curvature = size * rate * (1 - rate / cap)
        move = gradient / F.greatest(curvature, F.lit(1e-9))
        return m + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), move))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)
    # Targets at the bounds lie at infinite multipliers; empty sources keep the prior rate.
    rate = F.when(size == 0, 1.0).when(target >= size * cap, float(cap)).when(target <= 0, 0.0).otherwise(tilt(solved, cap))
    return targets.withColumn("__rate", rate)


def _rounded(cells: DataFrame) -> DataFrame:
    """__s, __z, __extra: how many documents of a source and size get one copy more than the whole ones.

    Sizes come from large to small; each takes the number nearest to its share plus the error so far. The
    errors are first carried over blocks of sizes, then from each block's start over its own sizes.
    """
    part = F.col("__rate") - F.floor("__rate")

    def serve(error: Column, cell: Column) -> tuple[Column, Column]:
        due = error + part * cell["docs"] * cell["size"]
        extra = F.least(cell["docs"], F.greatest(F.lit(0).cast("bigint"), F.round(due / cell["size"]).cast("bigint")))
        return due - extra * cell["size"], extra

    def carry(error: Column, block: Column) -> Column:
        return F.aggregate(block, error, lambda e, cell: serve(e, cell)[0])

    listed = cells.groupBy("__source", "__rate").agg(
        F.sort_array(F.collect_list(F.struct(F.col("__size").alias("size"), F.col("__docs").alias("docs"))), asc=False).alias("__cells")
    )
    count = F.ceil(F.size("__cells") / BLOCK_SIZES).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("__cells", i * BLOCK_SIZES + 1, BLOCK_SIZES))
    begun = listed.select("__source", "__rate", blocks.alias("__blocks")).withColumn(
        "__errors", F.aggregate("__blocks", F.array(F.lit(0.0)), lambda done, block: F.concat(done, F.array(carry(F.element_at(done, -1), block))))
    )
    block = begun.select("__source", "__rate", "__errors", F.posexplode("__blocks").alias("__at", "__block")).withColumn(
        "__error", F.get("__errors", F.col("__at"))
    )

    def step(done: Column, cell: Column) -> Column:
        error, extra = serve(F.element_at(done, -1)["error"], cell)
        return F.concat(done, F.array(F.struct(error.alias("error"), extra.alias("extra"), cell["size"].alias("size"))))

    none = F.lit(0).cast("bigint")
    start = F.array(F.struct(F.col("__error").alias("error"), none.alias("extra"), none.alias("size")))
    states = block.select("__source", F.explode(F.slice(F.aggregate("__block", start, step), 2, BLOCK_SIZES)).alias("__state"))
    return states.select(F.col("__source").alias("__s"), F.col("__state.size").alias("__z"), F.col("__state.extra").alias("__extra"))


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, id_column: str = "doc_id") -> DataFrame:
    """doc_id, __key, source, size, source_size, target, copies: one row for each input row, narrow.

    __key tells apart rows that differ; rows alike in id, source and text share it.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("__source"),
        word_count(F.col("text").cast("string")).alias("__size"),
        F.xxhash64(F.col(id_column).cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string")).alias("__key"),
    )
    sizes = cut(narrow, spark)
    targets = cut(multipliers(source_targets(sizes, weights, cap), cap), spark)
    counted = sizes.groupBy("__source", "__size").agg(F.count(F.lit(1)).alias("__docs"))
    # One row per source and size: joined null-safe, as null is a source too.
    of = targets.withColumnRenamed("__source", "__s")
    cells = cut(counted.join(of, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s"), spark)
    extra = _rounded(cells.filter("__size > 0"))
    same_cell = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))
    plan = cut(
        cells.join(extra, same_cell, "left").select(
            F.col("__source").alias("__s"), F.col("__size").alias("__z"), "__docs", "__rate", "source_size", "target",
            F.coalesce("__extra", F.lit(0).cast("bigint")).alias("__extra"), F.ceil(F.col("__docs") / BUCKET_ROWS).cast("bigint").alias("__buckets"),
        ), spark,
    )
    dealt = sizes.join(plan, same_cell).drop("__s", "__z").withColumn("__bucket", F.pmod(F.xxhash64("__key", F.lit(11)), F.col("__buckets")))
    # A cell's extra copies are shared among its buckets by their running document counts.
    cell = ["__source", "__size"]
    held = dealt.groupBy(*cell, "__bucket", "__docs", "__extra").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*cell).orderBy("__bucket"))
    share = lambda n: F.floor(F.col("__extra") * n / F.col("__docs"))
    quota = held.select(
        F.col("__source").alias("__s"), F.col("__size").alias("__z"), F.col("__bucket").alias("__b"),
        (share(upto) - share(upto - F.col("__n"))).alias("__quota"),
    )
    same = same_cell & (F.col("__bucket") == F.col("__b"))
    place = F.row_number().over(Window.partitionBy(*cell, "__bucket").orderBy(F.xxhash64("__key", F.lit(7)), "doc_id"))
    placed = dealt.join(quota, same).withColumn("__place", place)
    taken = F.when(F.col("__size") == 0, F.lit(1)).otherwise(
        F.floor("__rate") + F.when(F.col("__place") <= F.col("__quota"), 1).otherwise(0)
    )
    return placed.select(
        "doc_id", "__key", F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target",
        taken.cast("bigint").alias("copies"),
    )


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies), copies, source of each document."""
    return copies(docs, weights, cap).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source"
    )


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents, each as often as the mix takes it, columns as they came."""
    names = docs.columns
    keyed = docs.withColumn(
        "__key", F.xxhash64(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
    )
    # Rows alike in id, source and text are one row here, with their copies added up.
    wanted = copies(docs, weights, cap).groupBy("__key").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__alike"))
    spread = keyed.join(wanted, "__key")
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))
    several = spread.filter("__alike > 1").withColumn("__place", place).withColumn(
        "__copies", F.expr("__copies div __alike + if(__place <= __copies % __alike, 1, 0)")
    ).drop("__place")
    each = spread.filter("__alike = 1").unionByName(several)
    return each.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*names)
