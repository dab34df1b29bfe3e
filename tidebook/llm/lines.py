"""Repeated and nearly repeated lines, by an exact set-similarity join.

A line's set holds its distinct words (A-Z lower-cased, cut at ASCII white space). A later line is removed
if an earlier line of the corpus has Jaccard similarity of 0.75 or more with it. Lines with one set are one
class, placed where it occurs first; every later occurrence goes.

Classes meet under the words of their prefix: words are ordered from rare to frequent, and two sets that are
similar enough share one of the first n - ceil(3n/4) + 1. Word frequencies are counted over all lines in a
table of fixed size by hash; words that share a slot only share a rank, which leaves the order total. Pairs
pass a length filter, a positional filter and a bound from 64 parity bits (128 between long lines), all of
which only drop pairs that cannot reach the threshold, and are verified on the full sets.

Under each word the rows lie in order of length, and each row first looks at a window of neighbours and
takes its best earlier one. A class not matched so, but with further partners or with rows of a fitting length
beyond the window, then meets all rows of the word, in blocks of bounded size. So the result is exact and groups of copies are never expanded into pairs.

Lines are ordered by (doc_id, line number); null ids come last. Lines at the same place of rows with one id
count as one line if they are equal, else the order is that of their keys. Null and empty texts have no
lines; lines without words stay. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm import hashing
from tidebook.llm.minhash import FILTER_BITS, bit_of, bitmap, bitmap_slots, compare, marked
from tidebook.llm.tables import batches_by_rows, narrow, wide
from tidebook.session import cut

SLOTS = 1 << 20
SLICES = 64
GROUPS = 8  # of tasks whose tables are added up first
WINDOW = 512
TRIED = 8  # partners in the window that a row is tried with before it is looked at again
WIDE = 64  # lines of more words have 128 parity bits
BLOCK_ROWS = 1024
LAST = (1 << 63) - 1
ORDER = ["doc_id", "line_no", "key"]  # of lines; the key where rows of one id differ at a place


def _parts(text: bytes) -> Iterator[bytes]:
    """Stretches of whole lines of at most about hashing.BLOCK bytes."""
    begin = 0
    while len(text) - begin > hashing.BLOCK:
        end = text.rfind(b"\n", begin, begin + hashing.BLOCK)
        end = text.find(b"\n", begin + hashing.BLOCK) if end < 0 else end
        if end < 0:
            break
        yield text[begin:end]
        begin = end + 1
    yield text[begin:]


def _line_words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of lines: text and number of each line, and hash and line of each word."""
    def made(data: bytes, owner: list[int], first_number: list[int], lines: list[int]):
        hashes, starts = hashing.words(data)
        number_of = np.cumsum(np.frombuffer(data, np.uint8) == 10, dtype=np.int32)
        text = np.repeat(owner, lines)
        number = np.arange(len(text)) - np.repeat(np.cumsum(lines) - lines, lines) + np.repeat(first_number, lines)
        return text, number, hashes, number_of[starts]

    waiting: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        if len(text) > hashing.BLOCK:
            first = 0
            for part in _parts(text):
                count = part.count(b"\n") + 1
                yield made(part, [i], [first], [count])
                first += count
            continue
        waiting.append(i)
        held += len(text)
        if held > hashing.BLOCK:
            yield made(b"\n".join(texts[j] for j in waiting), waiting, [0] * len(waiting), [texts[j].count(b"\n") + 1 for j in waiting])
            waiting, held = [], 0
    if waiting:
        yield made(b"\n".join(texts[j] for j in waiting), waiting, [0] * len(waiting), [texts[j].count(b"\n") + 1 for j in waiting])


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def rarity(docs: DataFrame) -> bytes:
    """One byte per slot: how frequent the words of a slot are over all lines, on a logarithmic scale.

    Tasks count into whole tables, which are added up slice by slice, in groups of tasks first.
    """
    size = SLOTS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, np.int64)
        waiting, held = [], 0
        for batch in batches:
            for _, _, hashes, _ in hashing.document_words([t or b"" for t in batch.column(0).to_pylist()]):
                waiting.append(_slot(hashes))
                held += len(hashes)
                if held > SLOTS:  # a pass over the table for that many words, not for each group of texts
                    table += np.bincount(np.concatenate(waiting), minlength=SLOTS)
                    waiting, held = [], 0
        if waiting:
            table += np.bincount(np.concatenate(waiting), minlength=SLOTS)
        parts = [narrow(p) for p in table.reshape(SLICES, -1)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["task", "slice", "counts"]
        )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(wide(c, size) for c in group["counts"])
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "counts": [narrow(total)]})

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "task bigint, slice int, counts binary")
    near = counted.groupBy("slice", F.pmod("task", F.lit(GROUPS)).alias("part")).applyInPandas(add, "slice int, counts binary")
    rows = near.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    table = np.zeros(SLOTS, np.int64)
    for row in rows:  # 8 bytes a slot at most
        table[row["slice"] * size : (row["slice"] + 1) * size] = wide(row["counts"], size)
    return np.minimum(8 * np.log2(1 + table), 255).astype(np.uint8).tobytes()


def _by_line(member: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Order by line, then member. Equal words of a line are one, so only the second sort has to be stable."""
    order = np.argsort(member)
    of = line[order]
    return order[np.argsort(of.astype(np.uint16) if of.max(initial=0) < 1 << 16 else of, kind="stable")]


def _line_sets(texts: list[bytes], ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Text, number, members (rare ones first), begins and key of each line with words."""
    for text, number, hashes, line in _line_words(texts):
        if not len(hashes):
            continue
        member = (ranks[_slot(hashes)].astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
        order = _by_line(member, line)
        member, line = member[order], line[order]
        fresh = np.ones(len(member), bool)
        fresh[1:] = (member[1:] != member[:-1]) | (line[1:] != line[:-1])
        member, line = member[fresh], line[fresh]
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        with np.errstate(over="ignore"):
            keys = np.column_stack([np.add.reduceat(hashing.mix(member ^ np.uint64(salt)), first) for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)])
        at = line[first]
        yield text[at], number[at], member, np.append(first, len(member)), [k.tobytes() for k in keys]


def _needed(n):
    """Words of a set of n words that any similar set shares at least."""
    return -(-3 * n // 4)


def line_table(docs: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, line_no, key, n (words), bits, more, prefix of each line with words; repeated rows give repeated lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(ranks, np.uint8)
        for batch in batches:
            for text, number, member, begins, keys in _line_sets([t or b"" for t in batch.column(1).to_pylist()], rank):
                n = np.diff(begins)
                mixed = hashing.mix(member)
                parity = np.uint64(1) << (mixed & np.uint64(63))
                bits = np.bitwise_xor.reduceat(parity, begins[:-1]).view(np.int64)
                upper = np.where(mixed & np.uint64(64), parity, np.uint64(0))
                more = np.where(n > WIDE, np.bitwise_xor.reduceat(upper, begins[:-1]).view(np.int64), 0)
                length = n - _needed(n) + 1
                offsets = np.append(0, np.cumsum(length))
                place = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begins[:-1], length)
                tokens = (mixed[place] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text)), pa.array(number.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(n.astype(np.int32)), pa.array(bits), pa.array(more), prefix],
                    names=["doc_id", "line_no", "key", "n", "bits", "more", "prefix"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, line_no int, key binary, n int, bits bigint, more bigint, prefix array<int>")


def _possible(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs may reach the threshold, by length, positional and parity bounds; and parity bits that differ.

    Between long lines `bits` is the sum of two halves of 64 bits, of which `more` is one.
    """
    total = a["n"] + b["n"]
    need = -(-3 * total // 7)
    half = np.where((a["n"] > WIDE) & (b["n"] > WIDE), a["more"] ^ b["more"], np.uint64(0))
    apart = (np.bitwise_count(a["bits"] ^ b["bits"] ^ half) + np.bitwise_count(half)).astype(np.int64)
    shared = np.minimum(a["n"] - a["place"], b["n"] - b["place"])
    fits = 4 * np.minimum(a["n"], b["n"]) >= 3 * np.maximum(a["n"], b["n"])
    return fits & (shared >= need) & ((total - apart) // 2 >= need), apart


def _by_word(lines: DataFrame) -> DataFrame:
    """(word, key, bits, more, place) of each word of the lines' prefixes, the rows of a word together and in order of length.

    `word` holds the token above the length: one number to sort by, which Spark does by radix and not by comparing rows.
    """
    rows = lines.select(F.col("uid").alias("key"), "n", "bits", "more", F.posexplode("prefix").alias("place", "token"))
    word = F.shiftleft(F.col("token").cast("bigint"), 32).bitwiseOR(F.col("n").cast("bigint")).alias("word")
    return rows.select(word, "key", "bits", "more", "place").repartition(F.shiftright("word", 32)).sortWithinPartitions("word")


def _nearest(rows: DataFrame) -> DataFrame:
    """(key, with, others, open, token) per row of _by_word with possible earlier partners near it under its word, or more to look at.

    `with` is the partner of the most alike parity bits, `others` are up to TRIED of all; open rows have more.

    Rows arrive sorted by (token, n); a batch keeps the last WINDOW rows for the next one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "n", "place", "bits", "more", "key")
        tail, old = None, 0
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names[2:]}
            word = batch.column("word").to_numpy(zero_copy_only=False)
            new |= {"token": (word >> 32).astype(np.int32), "n": (word & 0xFFFFFFFF).astype(np.int32)}
            col = {c: np.concatenate([tail[c], new[c]]) if old else new[c] for c in names}
            for c in ("bits", "more"):
                col[c] = col[c].view(np.uint64)
            for c in ("n", "place"):
                col[c] = col[c].astype(np.int64)
            keys, n, size = col["key"], col["n"], len(col["key"])
            best = np.full(size, 255, np.int64)
            chosen = np.full(size, -1, np.int64)
            found = np.zeros(size, np.int64)
            slots = np.full((size, TRIED), -1, np.int64)
            # Within a word n rises, so a row that is too short for the one d further on is too short for all after it.
            longest = np.minimum(4 * n // 3, (7 * (n - col["place"])) // 3 - n)
            live = np.arange(size)
            for d in range(1, WINDOW + 1):
                live = live[live < size - d]
                live = live[(col["token"][live] == col["token"][live + d]) & (n[live + d] <= longest[live])]
                if not len(live):
                    break
                # Pairs of which the second is new; the others were looked at before.
                low = live[live + d >= old]
                high = low + d
                ok, apart = _possible(*({c: col[c][side] for c in names[1:5]} for side in (low, high)))
                low, high, apart = low[ok], high[ok], apart[ok]
                early = keys[low] < keys[high]
                for later, earlier, mask in ((high, low, early), (low, high, ~early)):
                    at, to, gap = later[mask], earlier[mask], apart[mask]
                    room = found[at] < TRIED
                    slots[at[room], found[at[room]]] = to[room]
                    found[at] += 1
                    better = gap < best[at]
                    best[at[better]], chosen[at[better]] = gap[better], to[better]
            # Rows whose word has further rows of a fitting length beyond the window.
            far = np.zeros(size, bool)
            if size > WINDOW:
                same = col["token"][WINDOW:] == col["token"][:-WINDOW]
                far[WINDOW:] = same & (4 * n[:-WINDOW] >= 3 * n[WINDOW:])
                far[:-WINDOW] |= same & (n[WINDOW:] <= longest[:-WINDOW])
            told = np.flatnonzero((chosen >= 0) | far)
            others = slots[told]
            others = others[others >= 0]
            offsets = np.append(0, np.cumsum(np.minimum(found[told], TRIED)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[told]), pa.array(keys[chosen[told]], mask=chosen[told] < 0),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[others])),
                    pa.array(((found > TRIED) | far)[told]), pa.array(col["token"][told].astype(np.int32)),
                ],
                names=["key", "with", "others", "open", "token"],
            )
            keep = max(0, size - WINDOW)
            tail = {c: v[keep:] for c, v in col.items()}
            for c in ("bits", "more"):
                tail[c] = tail[c].view(np.int64)
            old = size - keep

    return rows.mapInArrow(run, "key bigint, with bigint, others array<bigint>, open boolean, token int")


def _rows_of(table: DataFrame, classes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(key, n, bits, more, place, token) of the classes' words that are among the tokens.

    A bitmap of fixed size over hashed words leaves out most others before rows are made, so that only those are
    shuffled; the joins after it are exact.
    """
    # Tokens are hashes already.
    chosen = np.frombuffer(bitmap(tokens, lambda token: token.cast("bigint").bitwiseAND(F.lit(FILTER_BITS - 1))), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(6).flatten().to_numpy() & (FILTER_BITS - 1)
            lengths = batch.column(6).value_lengths().to_numpy()
            line = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(line)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            hit = np.flatnonzero(chosen[marks >> 3] >> (marks & 7) & 1)
            rows = batch.select([0, 1, 2, 3, 4, 5]).take(pa.array(line[hit]))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(place[hit].astype(np.int32)), batch.column(6).flatten().take(pa.array(hit))],
                names=["doc_id", "line_no", "key", "n", "bits", "more", "place", "token"],
            )

    made = table.select(*ORDER, "n", "bits", "more", "prefix").mapInArrow(
        run, "doc_id bigint, line_no int, key binary, n int, bits bigint, more bigint, place int, token int"
    )
    return made.join(tokens, "token", "left_semi").join(classes, ORDER).select(F.col("uid").alias("key"), "n", "bits", "more", "place", "token")


def _all_earlier(table: DataFrame, classes: DataFrame, open_rows: DataFrame) -> DataFrame:
    """Possible earlier partners of the open (key, token), out of all rows of the word, in blocks."""
    tokens = open_rows.select("token").distinct()
    rows = cut(_rows_of(table, classes, tokens), table.sparkSession)
    sizes = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    here = cut(rows.join(sizes, "token").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), rows.sparkSession)
    names = ["n", "place", "bits", "more"]
    asking = here.join(open_rows.select("key", "token"), ["key", "token"], "left_semi").select(
        F.col("token"), F.col("key").alias("later"), *[F.col(c).alias(f"l_{c}") for c in names],
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    # The same bounds as in _possible, inside the join.
    need = F.expr("(3 * (n + l_n) + 6) div 7")
    half = f"if(n > {WIDE} and l_n > {WIDE}, more ^ l_more, 0L)"
    bounds = (
        (4 * F.least("n", "l_n") >= 3 * F.greatest("n", "l_n"))
        & (F.least(F.col("n") - F.col("place"), F.col("l_n") - F.col("l_place")) >= need)
        & (F.expr(f"(n + l_n - bit_count(bits ^ l_bits ^ {half}) - bit_count({half})) div 2") >= need)
        & (F.col("key") < F.col("later"))
    )
    return here.join(asking, ["token", "block"]).filter(bounds).select(F.col("later").alias("key"), F.col("key").alias("with")).distinct()


def _key_bit(key: Column) -> Column:
    """A bit of a bitmap for a key; keys are hashes already."""
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 3)), 16, 10).cast("bigint"), F.lit(FILTER_BITS))


def _key_bits(keys: list[bytes]) -> np.ndarray:
    head = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)[:, :3].astype(np.int64)
    return (head @ np.array([1 << 16, 1 << 8, 1])) % FILTER_BITS


def _chosen_lines(docs: DataFrame, ranks: bytes, wanted: DataFrame) -> DataFrame:
    """(key, members) of the wanted (key, doc_id): sets made again from the texts that hold them.

    Bitmaps of fixed size over hashed ids and over keys leave out most other texts and lines; the join after them is exact.
    """
    of_keys = np.frombuffer(bitmap(wanted.select("key"), _key_bit), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(ranks, np.uint8)
        for batch in batches:
            for _, _, member, begins, keys in _line_sets([t or b"" for t in batch.column(0).to_pylist()], rank):
                marks = _key_bits(keys)
                hit = np.flatnonzero(of_keys[marks >> 3] >> (marks & 7) & 1)
                members = [member[begins[i] : begins[i + 1]].tobytes() for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.binary()), pa.array(members, pa.binary())], names=["key", "members"])

    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    texts = marked(docs.select(bit_of(doc).alias("bit"), F.col("text").cast("binary").alias("text")), bitmap_slots(wanted.select("doc_id")))
    made = texts.select("text").mapInArrow(run, "key binary, members binary")
    return made.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("members").alias("members"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, key, removed) of every line with words; line numbers count from 0."""
    spark = docs.sparkSession
    ranks = rarity(docs)
    table = cut(line_table(docs, ranks), spark)
    doc = F.coalesce("doc_id", F.lit(LAST))
    firsts = table.groupBy("key").agg(F.min(F.struct(doc.alias("doc_id"), "line_no")).alias("r")).select("key", "r.*")
    # Range partitions follow each other, so these numbers are in the order of the lines.
    classes = cut(firsts.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("uid", F.monotonically_increasing_id()), spark)
    placed = table.withColumn("doc_id", doc)
    with batches_by_rows(spark):
        first = cut(_nearest(_by_word(placed.join(classes, ORDER))), spark)

    def sets(keys: DataFrame) -> DataFrame:
        wanted = cut(keys.withColumnRenamed("key", "uid").join(classes, "uid").select("uid", "key", "doc_id"), spark)
        return _chosen_lines(docs, ranks, wanted).join(wanted.select("uid", "key"), "key").select(F.col("uid").alias("key"), "members")

    best = first.filter(F.col("with").isNotNull()).select("key", "with").distinct()
    matched = compare(best, sets).select("key").distinct()
    others = first.join(matched, "key", "left_anti").select("key", F.explode("others").alias("with")).distinct()
    others = cut(others.join(best, ["key", "with"], "left_anti"), spark)
    if not others.isEmpty():
        matched = cut(matched.union(compare(others, sets).select("key")).distinct(), spark)
    still = cut(first.filter("open").select("key", "token").distinct().join(matched, "key", "left_anti"), spark)
    if not still.isEmpty():
        asked = _all_earlier(placed, classes, still).join(best.union(others), ["key", "with"], "left_anti")
        matched = matched.union(compare(cut(asked, spark), sets).select("key")).distinct()
    fate = classes.select("key", F.col("doc_id").alias("at_doc"), F.col("line_no").alias("at_line"), "uid").join(
        matched.select(F.col("key").alias("uid"), F.lit(True).alias("similar")), "uid", "left"
    ).drop("uid")
    moved = (doc != F.col("at_doc")) | (F.col("line_no") != F.col("at_line"))
    return table.select("doc_id", "line_no", "key").join(fate, "key").select(
        "doc_id", "line_no", "key", (F.coalesce("similar", F.lit(False)) | moved).alias("removed")
    )


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines (with words), n_removed, removed_lines (their numbers from 0, in order).

    Documents without such lines have zeros and an empty list; rows of one id are one document here.
    """
    by = removed_lines(docs).select("doc_id", "line_no", "removed").groupBy("doc_id", "line_no").agg(F.min("removed").alias("removed"))
    found = by.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("removed").alias("n_removed"),
        F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line_no")))).alias("removed_lines"),
    )
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().withColumnRenamed("doc_id", "__id")
    none = F.lit(0).cast("bigint")
    return ids.join(found, F.col("__id").eqNullSafe(F.col("doc_id")), "left").select(
        F.col("__id").alias("doc_id"), F.coalesce("n_lines", none).alias("n_lines"), F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce(F.array_join("removed_lines", ","), F.lit("")).alias("removed_lines"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """All documents with the removed lines left out of their texts; an n_chars column follows the text.

    For rows of one id a line goes if it is removed at its number in all of them.
    """
    by = removed_lines(docs).select("doc_id", "line_no", "removed").groupBy("doc_id", "line_no").agg(F.min("removed").alias("removed"))
    gone = by.filter("removed").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(gone, docs["doc_id"].cast("bigint").eqNullSafe(F.col("__id")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)
    changed = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return changed.select(*docs.columns)
