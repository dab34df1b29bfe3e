"""Near copies by b-bit MinHash.

A document's set holds its distinct shingles of five words. Each set gets minima under 128 permutations.
Bands of four minima are the keys under which candidates meet; of each minimum only four low bits are
kept, packed, and two signatures' similarity is estimated by counting equal bit groups, corrected for the
chance that different minima agree in these bits. Candidates whose estimate is not far below the
threshold are confirmed on the full sets. A pair at the threshold shares no band with a chance of
5e-6, and is estimated so low with a chance under 1e-6.

Documents with the same set are one class from the start. In each bucket every class first meets the
smallest one, and links so found give components. Only buckets that then hold several components are
looked at again: classes outside the main component meet all others, in blocks of bounded size. Of a block only the
classes with a candidate in another component are told, each once; their full sets then meet in the block, where
every candidate is confirmed and a link is given only if it joins components not yet joined there. So no link between
components is lost, and neither groups of copies nor families just below the threshold are expanded into pairs.

Nulls and empty texts have no set and are linked with nothing. Rows with a null id are linked with
nothing, too, and kept. Rows of one id are one document for the links. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm import tables
from tidebook.llm.components import components
from tidebook.llm.hashing import document_words, mix, shingles
from tidebook.session import cut

SHINGLE = 5
PERMUTATIONS, ROWS, BITS = 128, 4, 4
NUMERATOR, DENOMINATOR = 75, 100
SLACK = 0.2  # estimates down to the threshold less this are confirmed on full sets
BLOCK_SETS = 1024  # sets that meet in one task at once, at most about
BLOCK_SHINGLES = 1 << 21  # and their shingles, at most about, but for single larger sets
MET_AT_ONCE = 1 << 16  # pairs compared in one step
FILTER_BITS = 1 << 23


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def _minima(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Minima (sets x permutations) of non-empty sets."""
    out = np.empty((len(begins) - 1, PERMUTATIONS), np.uint64)
    with np.errstate(over="ignore"):
        for p, factor in enumerate(_multipliers()):
            out[:, p] = np.minimum.reduceat(values * factor, begins[:-1])
    return out


def _packed(minima: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, in 64-bit words."""
    low = (minima >> np.uint64(20)) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shifts = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    return np.bitwise_or.reduce(low.reshape(len(low), -1, per) << shifts, axis=2)


def _bands(minima: np.ndarray) -> np.ndarray:
    parts = minima.reshape(len(minima), -1, ROWS)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (last axis: their words)."""
    differs = a ^ b
    for shift in (1, 2)[: BITS.bit_length() - 1]:
        differs = differs | (differs >> np.uint64(shift))
    ones = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    equal = 1 - np.bitwise_count(differs & ones).sum(axis=-1) / PERMUTATIONS
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def _set_key(values: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """128 bits that tell sets apart: two sums over differently mixed members."""
    with np.errstate(over="ignore"):
        sums = [np.add.reduceat(mix(values ^ np.uint64(salt)), begins[:-1]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return [x.tobytes() for x in np.column_stack(sums)]


def _sets(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of texts with words, their shingle hashes, and where each one's begin."""
    for first, _, hashes, begins in document_words(texts):
        values, at = shingles(hashes, begins, SHINGLE)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            yield first + full, values, np.append(at[:-1][full], len(values))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (of the set), packed, bands; without words: 0 and nulls."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            sizes = np.zeros(len(texts), np.int64)
            keys, packed, bands = [None] * len(texts), [None] * len(texts), [None] * len(texts)
            for rows, values, begins in _sets(texts):
                minima = _minima(values, begins)
                sizes[rows] = np.diff(begins)
                for row, key, bits, band in zip(rows, _set_key(values, begins), _packed(minima), _bands(minima), strict=True):
                    keys[row], packed[row], bands[row] = key, bits.tobytes(), band
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(packed, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "key", "packed", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, key binary, packed binary, bands array<bigint>")


def bit_of(column):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def bitmap_slots(values: DataFrame, bit=bit_of) -> DataFrame:
    """(slot, bits): a bitmap of the hashes of a single column in rows of 4096 bytes, FILTER_BITS of them however many values there are."""
    return values.toDF("v").select(bit(F.col("v")).alias("bit")).groupBy(F.expr("bit div 32768").alias("slot")).agg(
        F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits")
    )


def bitmap(values: DataFrame, bit=bit_of) -> bytes:
    """The bits of bitmap_slots in a row."""
    chosen = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in bitmap_slots(values, bit).collect():  # FILTER_BITS / 8 bytes at most
        chosen[row["slot"] * 4096 : (row["slot"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return chosen.tobytes()


def marked(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """The rows whose `bit` is set in bitmap_slots; no others reach Python."""
    byte = "conv(hex(substring(bits, cast((bit % 32768) div 8 + 1 as int), 1)), 16, 10)"
    met = rows.withColumn("slot", F.expr("bit div 32768")).join(F.broadcast(slots), "slot")
    return met.filter(F.expr(f"shiftright(cast({byte} as int), cast(bit % 8 as int)) & 1 = 1")).select(*rows.columns)


def _chosen_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, members) of the wanted (key, rep): their full sets, made again from the texts.

    A bitmap of fixed size over hashed ids leaves out most other texts before they are hashed; the join
    after it is exact.
    """
    chosen = bitmap(wanted.select("rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_pylist()
            here = [i for i, b in enumerate(bits) if b is not None and chosen[b >> 3] >> (b & 7) & 1]
            texts = batch.column(1).take(pa.array(here, pa.int64())).to_pylist()
            texts = [t or b"" for t in texts]
            for _, values, begins in _sets(texts):
                members = [values[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_set_key(values, begins), pa.binary()), pa.array(members, pa.binary())], names=["key", "members"])

    rows = docs.filter("doc_id is not null").select(bit_of(F.col("doc_id").cast("bigint")).alias("bit"), F.col("text").cast("binary").alias("text"))
    made = rows.mapInArrow(run, "key binary, members binary")
    return made.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("members").alias("members"))


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 times the shared members are at least 75 times all members."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def compare(pairs: DataFrame, sets_of) -> DataFrame:
    """The pairs (key, with) whose full sets are similar enough.

    Each set travels once per partner it is compared at; partners of one key are cut into blocks.
    `sets_of(keys)` gives (key, members) for a table of keys.
    """
    spark = pairs.sparkSession
    kind = pairs.schema["key"].dataType.simpleString()
    per = pairs.groupBy("with").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("blocks"))
    asked = pairs.join(per, "with").select("key", "with", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    own = per.select(F.col("with").alias("key"), "with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    places = cut(asked.union(own), spark)
    sets = cut(sets_of(places.select("key").distinct()), spark)

    held = places.join(sets, "key")
    base = held.filter(F.col("key") == F.col("with")).select("with", "block", F.col("members").alias("base"))
    met = held.filter(F.col("key") != F.col("with")).join(base, ["with", "block"]).select("key", "with", "members", "base")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (map(lambda m: np.frombuffer(m, np.uint64), batch.column(i).to_pylist()) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([_similar(a, b) for a, b in zip(*sides, strict=True)], pa.bool_()))

    return cut(met.mapInArrow(verify, f"key {kind}, with {kind}"), spark)


def _confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    estimated = _estimated(pairs, classes, docs.sparkSession)
    return compare(estimated, lambda keys: _chosen_sets(docs, keys.join(classes.select("key", "rep"), "key")))


def _estimated(pairs: DataFrame, classes: DataFrame, spark) -> DataFrame:
    side = classes.select("key", "n_shingles", "packed")
    other = classes.select(F.col("key").alias("with"), F.col("n_shingles").alias("n_with"), F.col("packed").alias("packed_with"))
    near = pairs.join(side, "key").join(other, "with").filter(
        DENOMINATOR * F.least("n_shingles", "n_with") >= NUMERATOR * F.greatest("n_shingles", "n_with")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
                hit = estimate(a, b) >= NUMERATOR / DENOMINATOR - SLACK
                yield batch.select([0, 1]).filter(pa.array(hit))

    return cut(near.select("key", "with", "packed", "packed_with").mapInArrow(run, "key binary, with binary"), spark)


def _across(members: DataFrame, classes: DataFrame, component_of: DataFrame) -> DataFrame:
    """(band, block, asks, key, component) of classes with a candidate of another component in the block: one that
    shares the bucket and is estimated similar. Held classes have asks 0, those that meet them 1."""
    placed = members.join(component_of, "key").withColumn("main", F.col("key") == F.col("leader"))
    facts = classes.select("key", "packed", "bands")
    mixed = placed.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES).alias("full"),
        F.max(F.when(F.col("main"), F.col("component"))).alias("main_component"),
    ).filter("low < high").select("band", "main_component", F.ceil("full").cast("int").alias("blocks"))
    rows = placed.join(mixed, "band").join(facts, "key").select(
        "band", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "key", "component", "n_shingles",
        "packed", "bands", (F.col("component") != F.col("main_component")).alias("minor"), "blocks",
    )
    rows = cut(rows, members.sparkSession)
    asking = rows.filter("minor").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(1)})
    met = rows.union(asking.select(*rows.columns)).drop("blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In each block the held rows come first, then the asking ones, which need not be held.
        place, held = None, []
        for batch in batches:
            part = Side(batch)
            if not len(part.band):
                continue
            ends = np.flatnonzero((np.diff(part.band) != 0) | (np.diff(part.block) != 0) | (np.diff(part.asks) != 0)) + 1
            told: list[tuple] = []
            for begin, end in zip(np.append(0, ends), np.append(ends, len(part.band)), strict=True):
                here = (part.band[begin], part.block[begin])
                if here != place:
                    place, held = here, []
                rows_here = part.rows(slice(begin, end))
                if not part.asks[begin]:
                    held.append(rows_here)
                    continue
                for left in held:
                    before = left.told.copy()
                    _meet(left, rows_here)
                    told += [(*here, 0, left.key[i], left.component[i]) for i in np.flatnonzero(left.told & ~before)]
                told += [(*here, 1, rows_here.key[i], rows_here.component[i]) for i in np.flatnonzero(rows_here.told)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in told], kind) for i, kind in enumerate(kinds)], names=["band", "block", "asks", "key", "component"]
            )

    dealt = met.repartition("band", "block").sortWithinPartitions("band", "block", "asks")
    return cut(dealt.mapInArrow(run, "band bigint, block int, asks int, key binary, component bigint"), members.sparkSession)


def _joining(docs: DataFrame, told: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (key, with) of told classes, at most one fewer in a block than components meet there."""
    spark = docs.sparkSession
    sets = cut(_chosen_sets(docs, told.select("key").distinct().join(classes.select("key", "rep"), "key")), spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block = None, None
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            columns = (batch.column(c).to_pylist() for c in ("band", "block", "asks", "key", "component"))
            for band, number, asks, key, component, members in zip(*columns, tables.values(batch.column("members")), strict=True):
                if (band, number) != place:
                    place, block = (band, number), Block()
                if asks:
                    found += block.links(key, component, np.frombuffer(members, np.uint64))
                else:
                    block.hold(key, component, np.frombuffer(members, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([pair[i] for pair in found], pa.binary()) for i in (0, 1)], names=["key", "with"])

    met = told.join(sets, "key").repartition("band", "block").sortWithinPartitions("band", "block", "asks")
    return cut(met.mapInArrow(run, "key binary, with binary"), spark)


class Block:
    """Full sets held in one block, and which components links have joined so far."""

    def __init__(self):
        self.keys, self.components, self.sets = [], [], []
        self.known = None
        self.joined: dict[int, int] = {}

    def hold(self, key: bytes, component: int, members: np.ndarray) -> None:
        self.keys.append(key)
        self.components.append(component)
        self.sets.append(members)

    def _root(self, component: int) -> int:
        while self.joined.get(component, component) != component:
            self.joined[component] = component = self.joined.get(self.joined[component], self.joined[component])
        return component

    def links(self, key: bytes, component: int, members: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """Links of a set to held sets whose components are not yet joined with its own."""
        if self.known is None:
            self.sizes = np.array([len(m) for m in self.sets])
            self.begins = np.cumsum(self.sizes) - self.sizes
            self.known, self.places = np.unique(np.concatenate(self.sets), return_inverse=True)
            self.sets = []
        at = np.minimum(np.searchsorted(self.known, members), len(self.known) - 1)
        mark = np.zeros(len(self.known), bool)
        mark[at[self.known[at] == members]] = True
        both = np.add.reduceat(mark[self.places], self.begins, dtype=np.int64)
        for i in np.flatnonzero(DENOMINATOR * both >= NUMERATOR * (self.sizes + len(members) - both)):
            one, other = self._root(component), self._root(self.components[i])
            if one != other:
                self.joined[max(one, other)] = min(one, other)
                yield key, self.keys[i]


class Side:
    """Columns of classes that lie in buckets."""

    def __init__(self, batch: pa.RecordBatch | None):
        if batch is None:
            return
        size = batch.num_rows
        self.band, self.block, self.asks, self.component, self.size = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "block", "asks", "component", "n_shingles")
        )
        self.minor = batch.column("minor").to_numpy(zero_copy_only=False).astype(bool)
        self.key = np.array([*batch.column("key").to_pylist(), None], object)[:-1]
        self.order = np.frombuffer(b"".join(self.key), np.uint64)[::2]
        self.packed = np.frombuffer(b"".join(batch.column("packed").to_pylist()), np.uint64).reshape(size, -1)
        self.bands = batch.column("bands").flatten().to_numpy().reshape(size, -1)
        self.told = np.zeros(size, bool)

    def rows(self, pick: slice) -> Side:
        out = Side(None)
        out.__dict__ = {name: values[pick] for name, values in self.__dict__.items()}
        return out


def _meet(left: Side, right: Side) -> None:
    """Mark as told the classes of both sides that are estimated similar to one of the other side and another component.

    A pair that shares several buckets counts in the first of them only.
    """
    step = max(1, MET_AT_ONCE // len(left.band))
    for begin in range(0, len(right.band), step):
        some = right.rows(slice(begin, begin + step))  # a view: what is told there is told in `right`
        fit = (some.component[:, None] != left.component) & (
            DENOMINATOR * np.minimum(some.size[:, None], left.size) >= NUMERATOR * np.maximum(some.size[:, None], left.size)
        )
        # Two minor classes would meet twice, once from each side.
        fit &= ~left.minor | (left.order <= some.order[:, None])
        r, l = np.nonzero(fit)
        near = estimate(some.packed[r], left.packed[l]) >= NUMERATOR / DENOMINATOR - SLACK
        r, l = r[near], l[near]
        if len(r):
            same = some.bands[r] == left.bands[l]
            here = left.bands[l, same.argmax(axis=1)] == left.band[0]
            some.told[r[here]] = True
            left.told[l[here]] = True


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept; one row per input row."""
    spark = docs.sparkSession
    signed = cut(signatures(docs), spark)
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(
        full.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles", "packed", "bands")).alias("r")).select(
            "key", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n_shingles"), F.col("r.packed").alias("packed"), F.col("r.bands").alias("bands")
        ), spark,
    )
    banded = classes.select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut(banded.join(buckets.drop("size"), "band"), spark)
    stars = members.filter("key <> leader").select(F.greatest("key", "leader").alias("key"), F.least("key", "leader").alias("with")).distinct()
    stars = cut(stars, spark)
    first = _confirmed(docs, stars, classes)

    reps = classes.select("key", "rep", "n_shingles")
    ends = reps.select(F.col("key").alias("with"), F.col("rep").alias("b"))
    # Rows of one id in different classes tie these classes together.
    several = Window.partitionBy("doc_id")
    ids = full.select("doc_id", "key").distinct().withColumn("n", F.count(F.lit(1)).over(several)).filter("n > 1")
    tied = ids.join(reps, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    def linked(confirmed: DataFrame) -> DataFrame:
        links = confirmed.join(reps, "key").join(ends, "with").select(F.col("rep").alias("a"), "b")
        return components(links.union(tied))

    def with_component(found: DataFrame) -> DataFrame:
        node = found.select(F.col("node").alias("rep"), "component")
        return reps.join(node, "rep", "left").select("key", "n_shingles", F.coalesce("component", "rep").alias("component"))

    told = _across(members, classes, cut(with_component(linked(first)), spark))
    final = with_component(linked(first.union(_joining(docs, told, classes)))).drop("n_shingles")
    rows = signed.select("doc_id", "n_shingles", "key").join(final, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without those that have a near copy of a smaller id; of repeated rows of an id, all stay or go."""
    gone = near_copies(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
