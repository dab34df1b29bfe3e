"""Connected components of a link table, by contracting it round after round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (a, b): the smallest node it reaches.

    Each round every node joins its smallest neighbour and links between the joined nodes remain, so
    chains shrink by a factor per round. Minima are pre-aggregated, so hubs do not gather in one task.
    """
    spark = links.sparkSession
    edges = cut(links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b").distinct(), spark)
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("parent"))
        parents = cut(parents, spark)
        if found is None:
            found = parents.select("node", F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("node").alias("component"), "parent")
            found = cut(found.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), spark)
        ends = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        other = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(ends, "a").join(other, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = cut(moved.filter("a <> b").distinct(), spark)
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
