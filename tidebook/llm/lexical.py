"""Exact ranked lexical search by inner product over ball trees of sparse document vectors.

Terms are the longest runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.
A document's component for a term is an integer that grows with the term's count and falls with the
document's length; an item's is the term's weight for every occurrence. The score is their inner product.

Items are answered in blocks. One pass over the documents counts the block's terms and all lengths, and
keeps each document's components of those terms in a table. Each task then takes its documents a few
hundred at a time and builds a ball tree of them: a node has the centroid of its documents and, for each
group of terms, the largest distance of a document from it in that group. The inner product with any
document below a node is at most that with the centroid plus, group by group, the item's length times the
radius. Nodes are opened by highest bound first until the bound falls below the tenth score found so far,
and the documents of a leaf are scored in 64-bit integers. Bounds are made in doubles and widened by far
more than rounding can take away, so no document that belongs to the result is passed over.

Frequent terms are groups of their own, the others form one group for each item that has them first.

Each task gives ten documents an item at most; they are ranked in two steps.

Null texts and texts without terms score nothing; items without terms get no rows. Equal scores are ranked
by id, null ids last. A repeated document is ranked each time, a repeated item is answered each time.
Texts of any length are read whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.tables import narrow, wide
from tidebook.llm.token_counts import groups
from tidebook.session import cut

TOP = 10
# Items answered in one pass, and different terms after which a block of items ends.
BLOCK_ITEMS = 512
BLOCK_TERMS = 20_000
# Numbers in a tree's dense rows, and documents in a tree and in a leaf.
TREE_CELLS = 4_000_000
TREE_DOCUMENTS = 2048
LEAF = 16
# So many of a block's most frequent terms are groups of their own.
SINGLE_GROUPS = 192
# The constants of the term weight and of the damped term count.
SCALE, DAMPING, EVEN, SLOPE = 1_000_000_000, 1000, 25, 75

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _byte_table() -> np.ndarray:
    """Each byte's lower case, 0 where no term has it."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for low, high in ((0, 48), (58, 65), (91, 97), (123, 128)):
        table[low:high] = 0
    return table


_LETTERS = _byte_table()


class Terms:
    """Hashes and places of the terms in some bytes."""

    def __init__(self, data: bytes):
        self.raw = _LETTERS[np.frombuffer(data, np.uint8)]
        inside = np.zeros(len(self.raw) + 2, bool)
        inside[1:-1] = self.raw != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, ends = edges[::2], edges[1::2]
        self.lengths = ends - self.starts
        n = len(self.raw) + 1
        with np.errstate(over="ignore"):
            power, inverse = np.full(n, _BASE), np.full(n, _INVERSE)
            power[0] = inverse[0] = 1
            np.multiply.accumulate(power, out=power)
            np.multiply.accumulate(inverse, out=inverse)
            sums = np.zeros(n, np.uint64)
            np.cumsum(self.raw * power[:-1], out=sums[1:])
            self.hashes = (sums[ends] - sums[self.starts]) * inverse[self.starts]

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()


class Lexicon:
    """The terms of a block of items, found in texts by hash and then compared byte by byte."""

    def __init__(self, words: list[bytes]):
        known = Terms(b" ".join(words))
        order = np.argsort(known.hashes, kind="stable")
        self.hashes = known.hashes[order]
        if len(np.unique(self.hashes)) < len(words):
            raise ValueError("two terms have one hash")
        self.number = order
        self.lengths = known.lengths
        self.longest = int(known.lengths.max(initial=0))
        self.letters = np.zeros((len(words), -(-self.longest // 8) * 8), np.uint8)
        for i, w in enumerate(words):
            self.letters[i, : len(w)] = np.frombuffer(w, np.uint8)
        self.letters = self.letters.view("<u8")

    def occurrences(self, found: Terms) -> tuple[np.ndarray, np.ndarray]:
        """(place among the terms found, number in the lexicon) of each occurrence."""
        at = np.searchsorted(self.hashes, found.hashes)
        at[at == len(self.hashes)] = 0
        place = np.flatnonzero(self.hashes[at] == found.hashes) if len(self.hashes) else np.zeros(0, np.int64)
        number = self.number[at[place]] if len(place) else np.zeros(0, np.int64)
        same = found.lengths[place] == self.lengths[number]
        padded = np.concatenate([found.raw, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        for k in range(self.letters.shape[1]):
            left = found.lengths[place] - 8 * k
            open_ = np.flatnonzero(same & (left > 0))
            if not len(open_):
                break
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * np.uint64(8 - np.minimum(left[open_], 8).astype(np.uint64)))
            same[open_] = (eight[found.starts[place[open_]] + 8 * k] & mask) == self.letters[number[open_], k]
        return place[same], number[same]


def _cut_texts(texts: list[bytes], limit: int) -> Iterator[tuple[int, bytes]]:
    """(text number, part) with long texts cut where no term goes on."""
    for i, text in enumerate(texts):
        begin = 0
        while len(text) - begin > limit:
            end = begin + limit
            while end < len(text) and _LETTERS[text[end]]:
                end += 1
            yield i, text[begin:end]
            begin = end
        yield i, text[begin:]


def term_counts(texts: list[bytes], lexicon: Lexicon, limit: int = 2_000_000) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each text's number of terms, and its lexicon terms with their counts."""
    total = np.zeros(len(texts), np.int64)
    keys: list[np.ndarray] = []
    size = max(len(lexicon.lengths), 1)
    batch: list[tuple[int, bytes]] = []

    def count() -> None:
        owners = np.array([i for i, _ in batch])
        begins = np.cumsum([0, *(len(t) + 1 for _, t in batch)])
        found = Terms(b" ".join(t for _, t in batch))
        bounds = np.searchsorted(found.starts, begins)
        np.add.at(total, owners, np.diff(bounds))
        place, number = lexicon.occurrences(found)
        owner = owners[np.searchsorted(begins, found.starts[place], side="right") - 1]
        keys.append(owner * size + number)

    held = 0
    for part in _cut_texts(texts, limit):
        if batch and held + len(part[1]) > limit:
            count()
            batch, held = [], 0
        batch.append(part)
        held += len(part[1])
    if batch:
        count()
    key, times = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    ends = np.searchsorted(key, np.arange(1, len(texts) + 1) * size)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return total, [(key[a:b] % size, times[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


class Items:
    """A block of items: their terms, weights and groups of terms."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        numbers: dict[bytes, int] = {}
        self.counts: list[Counter] = []
        for _, text in items:
            found = Terms((text or "").encode())
            self.counts.append(Counter(numbers.setdefault(found.word(k), len(numbers)) for k in range(len(found.starts))))
        self.words = list(numbers)

    def weigh(self, n_documents: int, holding: np.ndarray) -> None:
        """Term weights from the documents that hold each; and each item's terms, factors and groups."""
        weight = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
        group = np.full(len(self.words), -1, np.int64)
        single = np.argsort(-holding, kind="stable")[:SINGLE_GROUPS]
        group[single] = np.arange(len(single))
        n_groups = len(single)
        self.terms, self.factors = [], []
        for counts in self.counts:
            terms = np.array(sorted(t for t in counts if weight[t] and holding[t]), np.int64)
            self.terms.append(terms)
            self.factors.append(np.array([counts[t] * weight[t] for t in terms.tolist()], np.int64))
            own = terms[group[terms] < 0]
            if len(own):
                group[own] = n_groups
                n_groups += 1
        group[group < 0] = 0
        self.group, self.n_groups, self.weight = group, n_groups, weight
        # Of each item: its groups, and the length of its part in each, where lengths are in weighted terms.
        self.lengths = []
        for terms, factors in zip(self.terms, self.factors, strict=True):
            own, inverse = np.unique(group[terms], return_inverse=True)
            share = factors / weight[terms]
            self.lengths.append((own, np.sqrt(np.bincount(inverse, share * share, minlength=len(own)))))


class BallTree:
    """A ball tree over documents' components, searched by highest bound first."""

    def __init__(self, values: np.ndarray, items: Items):
        self.values, self.items = values, items
        # Distances are taken between components times their terms' weights.
        self._dense = (values * items.weight).astype(np.float32)
        by_group = np.argsort(items.group, kind="stable")
        self._by_group = by_group
        self._edges = np.searchsorted(items.group[by_group], np.arange(items.n_groups))
        # A sum of n single-precision squares is off by less than n parts in ten million.
        self._slack = 1 + 1e-7 * np.bincount(items.group, minlength=items.n_groups)
        self.rows: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.centroids: list[np.ndarray] = []
        self.radii: list[np.ndarray] = []
        if len(values):
            self._build(np.arange(len(values)))

    def _build(self, rows: np.ndarray) -> int:
        """Make a node of some documents and what lies below it."""
        here, part = len(self.rows), self._dense[rows]
        centre = part.mean(axis=0)
        off = part - centre
        off *= off
        radii = np.sqrt(np.add.reduceat(off[:, self._by_group], self._edges, axis=1).max(axis=0).astype(np.float64)) * self._slack
        self.rows.append(rows)
        self.centroids.append(centre)
        self.radii.append(radii)
        self.children.append(None)
        if len(rows) > LEAF:
            # Split at the middle of the line between two documents far apart.
            far = part[int(off.sum(axis=1).argmax())]
            gap = part - far
            other = part[int(np.einsum("ij,ij->i", gap, gap).argmax())]
            order = np.argsort(part @ (other - far), kind="stable")
            half = len(rows) // 2
            self.children[here] = self._build(rows[order[:half]]), self._build(rows[order[half:]])
        return here

    def bound(self, node: int, q: int) -> float:
        """No document below the node has a higher score."""
        items = self.items
        terms, (own, lengths) = items.terms[q], items.lengths[q]
        share = items.factors[q] / items.weight[terms]
        centre, radii = self.centroids[node][terms].astype(np.float64), self.radii[node][own]
        # Single-precision rows and centroids are off by less than a part in a million.
        return (float(share @ centre) + float(lengths @ radii)) * 1.00001 + float(share.sum()) * float(centre.max(initial=0.0) + radii.max(initial=0.0)) * 1e-5 + 1

    def search(self, q: int, best: Best) -> None:
        """Offer every document that may be among the best of an item."""
        terms, factors = self.items.terms[q], self.items.factors[q]
        if not self.rows or not len(terms):
            return
        heap = [(-self.bound(0, q), 0)]
        while heap and -heap[0][0] >= best.least:
            node = heapq.heappop(heap)[1]
            if self.children[node] is None:
                rows = self.rows[node]
                best.offer(self.values[np.ix_(rows, terms)] @ factors, rows)
                continue
            for child in self.children[node]:
                high = self.bound(child, q)
                if high >= best.least:
                    heapq.heappush(heap, (-high, child))


class Best:
    """The best documents met so far of one item: highest score, then smallest id, null ids last."""

    def __init__(self, take: int = TOP):
        self.take, self.least, self.kept, self.scored = take, 1, [], 0
        self.doc_ids: list[int | None] = []

    def offer(self, scores: np.ndarray, rows: np.ndarray) -> None:
        self.scored += len(rows)
        near = np.flatnonzero(scores >= self.least)
        if not len(near):
            return
        for i in near.tolist():
            doc_id = self.doc_ids[rows[i]]
            self.kept.append((-int(scores[i]), doc_id is None, doc_id or 0))
        self.kept.sort()
        del self.kept[self.take :]
        if len(self.kept) == self.take:
            self.least = -self.kept[-1][0]


def components(times: np.ndarray, length: int, n_documents: int, all_terms: int) -> np.ndarray:
    """A document's integer components from its term counts."""
    m = 100 - SLOPE + (SLOPE * length * n_documents) // all_terms
    return (SCALE * times) // (DAMPING * times + 8 * m)


def item_blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The query set, a block at a time."""
    rows = items.select(F.col(id_column).cast("bigint"), F.col(text_column)).toLocalIterator()
    block: list[tuple[int | None, str | None]] = []
    seen: set[bytes] = set()
    for item_id, text in rows:
        found = Terms((text or "").encode())
        if not len(found.starts):
            continue
        block.append((item_id, text))
        seen.update(found.word(k) for k in range(len(found.starts)))
        if len(block) == BLOCK_ITEMS or len(seen) >= BLOCK_TERMS:
            yield block
            block, seen = [], set()
    if block:
        yield block


_VECTORS = "doc_id bigint, length bigint, n bigint, terms binary, times binary"
_HITS = "item int, item_id bigint, doc_id bigint, score bigint"


def vectors(docs: DataFrame, words: list[bytes], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, length (all terms, with repeats), and the document's terms among `words` with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for a, b in groups(texts):
                length, found = term_counts(texts[a:b], lexicon)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(length), pa.array([len(t) for t, _ in found], pa.int64()),
                        pa.array([narrow(t) for t, _ in found], pa.binary()), pa.array([narrow(n) for _, n in found], pa.binary()),
                    ],
                    names=["doc_id", "length", "n", "terms", "times"],
                )

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("binary").alias("text")).mapInArrow(run, _VECTORS)


def _holding(found: DataFrame, n_words: int) -> np.ndarray:
    """In how many documents each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_words, np.int64)
        for batch in batches:
            for n, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[wide(terms, n)] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "documents"])

    counted = found.select("n", "terms").mapInArrow(run, "term bigint, documents bigint").groupBy("term").agg(F.sum("documents").alias("documents"))
    out = np.zeros(n_words, np.int64)
    for term, documents in counted.collect():  # at most one row for each of the block's terms
        out[term] = documents
    return out


def _search(found: DataFrame, items: Items, first: int, n_documents: int, all_terms: int, take: int) -> DataFrame:
    n_words = len(items.words)
    per_tree = max(LEAF, min(TREE_DOCUMENTS, TREE_CELLS // n_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(take) for _ in items.ids]
        held: list[tuple] = []

        def answer() -> None:
            values = np.zeros((len(held), n_words), np.int64)
            for i, (_, length, n, terms, times) in enumerate(held):
                values[i, wide(terms, n)] = components(wide(times, n), length, n_documents, all_terms)
            tree = BallTree(values, items)
            doc_ids = [row[0] for row in held]
            for q, kept in enumerate(best):
                kept.doc_ids = doc_ids
                tree.search(q, kept)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2]:
                    held.append(row)
                if len(held) == per_tree:
                    answer()
                    held = []
        if held:
            answer()
        rows = [
            (first + q, items.ids[q], None if null else doc_id, -score) for q, kept in enumerate(best) for score, null, doc_id in kept.kept
        ]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item", "item_id", "doc_id", "score"])

    return found.mapInArrow(run, _HITS)


def ranked(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text", take: int = TOP,
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `take` highest-scoring documents with a score above 0."""
    spark, answers, first = docs.sparkSession, None, 0
    for block in item_blocks(items, item_id_column, item_text_column):
        asked = Items(block)
        found = cut(vectors(docs, asked.words, id_column, text_column), spark)
        n_documents, all_terms = found.filter("length > 0").agg(F.count(F.lit(1)), F.sum("length")).first()
        if n_documents:
            asked.weigh(n_documents, _holding(found, len(asked.words)))
            hits = _search(found, asked, first, n_documents, all_terms, take)
            answers = hits if answers is None else answers.unionByName(hits)
        first += len(block)
    if answers is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # Ten of each share of the tasks first, then ten of all.
    shares = answers.withColumn("share", F.spark_partition_id() % 64)
    some = shares.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).filter(F.col("rank") <= take)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return some.withColumn("rank", rank).filter(F.col("rank") <= take).select("item_id", "rank", "doc_id", "score")
