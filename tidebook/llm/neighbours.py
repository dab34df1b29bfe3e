"""Approximate nearest neighbours with balanced posting lists.

Equal vectors are one entry, which stands for its smallest ids. Centroids are fitted on a bounded sample and
joined into a neighbour graph that every task holds in memory. Each entry goes into the list of its nearest
centroid and, near a boundary, into further lists almost as near. A query walks the graph to its nearest
centroids and reads a least number of lists, and further ones whose centroids are at most a ratio farther than
the nearest. Queries that have found too few read on, several times as many lists each time, up to all. Lists
with many entries are divided into parts of bounded size, which queries meet one by one, so no list is a large
group.

Vectors that are null, zero or hold null or non-finite components take no part, as queries neither. Vectors of
other dimensions than the most frequent one take no part either. Ties go to smaller ids; repeated ids with one
vector count once, with several vectors by their nearest. An empty table gives an empty result. Extra columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.session import cut

SAMPLE = 20_000  # vectors that the centroids are fitted on, at most about
LIST_SIZE = 200  # entries a list is meant to have, in corpora of up to LISTS lists
LISTS = 2_048
PART = 1_024
DEGREE = 24
BEAM = 64
COPIES, BOUNDARY = 6, 1.15  # lists of an entry at most; how much farther than the nearest
LEAST = 16  # lists of a query at least; one that lies on its centroid has no other within any ratio
PROBES, PRUNE = 48, 1.6  # lists of a query at first, at most; how much farther than the nearest
FURTHER = 4  # times as many lists for queries that found too few


class Graph:
    """Centroids and, for each, its nearest other centroids and some far ones."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        gaps = _distances(centroids, centroids)
        near = np.argsort(gaps, axis=1, kind="stable")[:, 1 : DEGREE + 1] if n > 1 else np.zeros((n, 1), int)
        spread = (np.arange(n)[:, None] + (1 << np.arange(4))[None, :] * max(n // 16, 1)) % n
        self.links = np.hstack([near, spread])
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(int))

    def search(self, vectors: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids found from the entry points along the links, nearest first, and their distances."""
        n, beam = len(self.centroids), min(len(self.centroids), max(BEAM, count))
        rows = np.arange(len(vectors))[:, None]
        if count > BEAM:  # so many that a walk would open most centroids
            gaps = _distances(vectors, self.centroids)
            order = np.argsort(gaps, axis=1, kind="stable")[:, :count]
            return order, gaps[rows, order]
        gaps = np.full((len(vectors), n), np.inf, np.float32)
        gaps[:, self.entry] = _distances(vectors, self.centroids[self.entry])
        opened = np.zeros((len(vectors), n), bool)
        norms = (vectors**2).sum(axis=1)
        own = (self.centroids**2).sum(axis=1)
        for _ in range(beam):
            best = np.argpartition(gaps, beam - 1, axis=1)[:, :beam]
            waiting = np.where(opened[rows, best] | ~np.isfinite(gaps[rows, best]), np.inf, gaps[rows, best])
            at = best[rows[:, 0], waiting.argmin(axis=1)]
            active = np.flatnonzero(np.isfinite(waiting.min(axis=1)))
            if not len(active):
                break
            opened[active, at[active]] = True
            to = self.links[at[active]]
            far = norms[active, None] + own[to] - 2 * np.einsum("qd,qkd->qk", vectors[active], self.centroids[to])
            gaps[active[:, None], to] = np.sqrt(np.maximum(far, 0))
        order = np.argsort(gaps, axis=1, kind="stable")[:, : min(count, n)]
        return order, gaps[rows, order]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def _fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Balanced centroids: Lloyd's steps, with centroids of small lists moved beside those of large ones."""
    rng = np.random.default_rng(17)
    lists = min(lists, len(sample))
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for turn in range(12):
        owner = np.concatenate([_distances(sample[i : i + 4096], centroids).argmin(axis=1) for i in range(0, len(sample), 4096)])
        sizes = np.bincount(owner, minlength=lists)
        order = np.argsort(owner, kind="stable")
        full = np.flatnonzero(sizes)
        centroids[full] = np.add.reduceat(sample[order], (np.cumsum(sizes) - sizes)[full], axis=0) / sizes[full, None]
        if turn < 8:
            small = np.flatnonzero(sizes * 4 < len(sample) / lists)
            large = np.argsort(-sizes, kind="stable")[: len(small)]
            for s, big in zip(small, large, strict=True):
                members = order[(np.cumsum(sizes) - sizes)[big] :][: sizes[big]]
                if sizes[big] > 1:
                    centroids[s] = sample[rng.choice(members)]
    return centroids


def valid_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, vector (of doubles) of the vectors that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    )
    rows = rows.filter(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (common["n"] if common else 0))


def _array(column: pa.Array | pd.Series) -> np.ndarray:
    return np.array(column.to_pylist() if isinstance(column, pa.Array) else column.tolist(), np.float64)


def search(vectors: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest found for each vector with is_query(id)."""
    spark = vectors.sparkSession
    rows = cut(valid_vectors(vectors, id_column, vector_column).distinct().withColumn("entry", F.md5(F.array_join("vector", ",").cast("binary"))), spark)
    # A query never needs more than k + 1 ids of one vector; limits of ranks apply before the shuffle.
    order = F.row_number().over(Window.partitionBy("entry").orderBy("vec_id"))
    kept = rows.withColumn("at", order).filter(F.col("at") <= k + 1)
    entries = cut(kept.groupBy("entry").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids")), spark)
    total = entries.count()
    share = min(1.0, SAMPLE / max(total, 1))
    picked = entries.filter(F.pmod(F.xxhash64("entry"), F.lit(1 << 40)) < int(share * (1 << 40))).orderBy("entry").select("vector").collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not picked:
        return spark.createDataFrame([], schema)
    sample = np.array([r["vector"] for r in picked], np.float32)
    graph = Graph(_fit(sample, max(1, min(LISTS, total // LIST_SIZE))))

    def near(batches: Iterator[pa.RecordBatch], count: int, ratio: float, least: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                lists, gaps = graph.search(_array(part.column("vector")).astype(np.float32), count)
                fit = gaps <= ratio * gaps[:, :1] + 1e-6
                fit[:, :least] = True
                owner, place = np.nonzero(fit)
                taken = part.take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lists[owner, place].astype(np.int32))], names=[*part.schema.names, "list"])

    def index(batches):
        return near(batches, COPIES, BOUNDARY, 1)

    posted = cut(entries.select("entry", "vector", "ids").mapInArrow(index, "entry string, vector array<double>, ids array<bigint>, list int"), spark)
    asked = cut(rows.filter(is_query(F.col("vec_id"))).select("entry").distinct().join(entries.select("entry", "vector"), "entry"), spark)
    # Large lists are divided by hash; one number per list.
    parts = cut(posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), spark)
    stored = posted.join(parts, "list").select("list", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int").alias("part"), "vector", "ids")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            held, ids = _array(left["vector"]), left["ids"].to_numpy()
            for query, of in zip(right["query"], right["of"], strict=True):
                gaps = np.sqrt(((held - np.asarray(of, np.float64)) ** 2).sum(axis=1))
                # Every entry at the distance of the (k + 1)-th may still matter for ties.
                limit = np.partition(gaps, k)[k] if len(gaps) > k + 1 else np.inf
                close = np.flatnonzero(gaps <= limit)
                found = sorted((gaps[i], int(v)) for i in close for v in ids[i])[: k + 1]
                out += [(query, v, float(g)) for g, v in found]
        return pd.DataFrame(out, columns=["query", "vec_id", "score"])

    # Copies in several lists and parts; then the best for each distinct query vector, and for each of its ids.
    best = Window.partitionBy("query").orderBy("score", "vec_id")

    def answered(asked: DataFrame, count: int, least: int) -> DataFrame:
        """query, vec_id, score: the k + 1 nearest ids in up to `count` lists of each query, the `least` nearest read anyway."""
        probes = asked.mapInArrow(lambda batches: near(batches, count, PRUNE, least), "entry string, vector array<double>, list int")
        asking = probes.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("entry").alias("query"), F.col("vector").alias("of"))
        met = stored.groupBy("list", "part").cogroup(asking.groupBy("list", "part")).applyInPandas(meet, "query string, vec_id bigint, score double")
        few = met.groupBy("query", "vec_id").agg(F.min("score").alias("score")).withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
        return cut(few.drop("at"), spark)

    few, count = answered(asked, PROBES, LEAST), PROBES
    while count < len(graph.centroids):
        # One of the k + 1 ids is the query's own.
        enough = few.groupBy("query").count().filter(F.col("count") > k).select(F.col("query").alias("entry"))
        short = cut(asked.join(enough, "entry", "left_anti"), spark)
        if short.isEmpty():
            break
        count *= FURTHER
        settled = few.join(short.select(F.col("entry").alias("query")), "query", "left_anti")
        few = settled.unionByName(answered(short, count, count))
    queries = rows.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query"))
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = queries.join(few, "query").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return ranked.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
