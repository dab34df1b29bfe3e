"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds the hash of every shingle below a fixed fraction of the hash range; of texts with few such
hashes it holds the smallest ones, up to a floor. A sketch is complete below its own bound, so any two
compare at the smaller bound: shared hashes over all hashes there estimate likeness, over one side's
hashes containment, even between very unequal texts. Sketches of parts merge into one of the whole.

Nulls count as empty texts; a text without words has an empty sketch, and any two empty sketches are alike
(1), an empty and another one not (0). Equal texts have equal fingerprints. Rows of one id follow each
other by text; null ids come last. Extra columns do not matter. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRACTION = 1 / 16
FLOOR = 64  # hashes kept of texts that have fewer than this below the fraction
WORDS = 2  # words in a shingle
RANGE = 1 << 62  # hashes lie between 0 and this
CHUNK_ROWS = 2_000  # rows of a chunk, in a corpus of up to 4096 chunks
SPACE = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """Hash of each word, lower-cased A-Z."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(lower, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(hashed: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of `words` word hashes, a column (of fewer words: of the whole run)."""
    few = F.when(F.size(hashed) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(hashed).bitwiseAND(RANGE - 1)))
    runs = F.transform(
        F.slice(hashed, 1, F.greatest(F.size(hashed) - (words - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(hashed, i + k) for k in range(1, words)]).bitwiseAND(RANGE - 1),
    )
    return F.when(F.size(hashed) < words, few).otherwise(runs)


def bound(fraction: float = FRACTION) -> int:
    return int(RANGE * fraction)


def sketch(docs: DataFrame, text: Column, name: str, fraction: float = FRACTION, floor: int = FLOOR, words: int = WORDS) -> DataFrame:
    """Adds the sketch of a text column: sorted distinct hashes below the fraction, or the `floor` smallest if those are more.

    Each step is a column of its own, so that what is used several times is made once.
    """
    made = docs.withColumn("__words", word_hashes(F.coalesce(text, F.lit(""))))
    made = made.withColumn("__hashes", shingle_hashes(F.col("__words"), words))
    made = made.withColumn("__below", F.array_distinct(F.filter("__hashes", lambda h: h < bound(fraction))))
    small = F.slice(F.sort_array(F.array_distinct("__hashes")), 1, floor)
    return made.withColumn(name, F.when(F.size("__below") >= floor, F.sort_array("__below")).otherwise(small)).drop("__words", "__hashes", "__below")


def complete_below(sketched: Column, fraction: float = FRACTION, floor: int = FLOOR) -> Column:
    """The bound under which a sketch misses no hash of its text."""
    full = F.size(sketched) >= floor
    return F.when(~full, F.lit(RANGE)).otherwise(F.greatest(F.element_at(sketched, -1) + 1, F.lit(bound(fraction))))


def _common(a: Column, b: Column) -> tuple[Column, Column, Column]:
    at = F.least(complete_below(a), complete_below(b))
    x, y = F.filter(a, lambda h: h < at), F.filter(b, lambda h: h < at)
    return F.size(F.array_intersect(x, y)), F.size(x), F.size(y)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the two texts' shingles, 0 to 1."""
    both, x, y = _common(a, b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        both.cast("double") / (x + y - both)
    )


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1."""
    both, x, _ = _common(a, b)
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).when(F.size(b) == 0, 0.0).otherwise(both.cast("double") / F.greatest(x, F.lit(1)))


def merged(a: Column, b: Column) -> Column:
    """Sketch of the texts' shingles together."""
    at = F.least(complete_below(a), complete_below(b))
    together = F.sort_array(F.array_distinct(F.concat(a, b)))
    below = F.filter(together, lambda h: h < at)
    # Complete over the whole range: cut as a sketch of its own is.
    small = F.when(F.size(F.filter(below, lambda h: h < bound())) >= FLOOR, F.filter(below, lambda h: h < bound())).otherwise(F.slice(below, 1, FLOOR))
    return F.when(at == RANGE, small).otherwise(below)


def written(sketched: Column) -> Column:
    """A sketch as text: hexadecimal hashes in order."""
    return F.array_join(F.transform(sketched, lambda h: F.lower(F.hex(h))), ".")


def _chunk_starts(docs: DataFrame, chunk_rows: int) -> list[int]:
    """Ids that cut the id range into chunks of about chunk_rows rows; one number per chunk comes to the driver."""
    rows = docs.count()
    pieces = min(max(1, rows // chunk_rows), 4096)
    if pieces == 1:
        return []
    cuts = docs.stat.approxQuantile("doc_id", [i / pieces for i in range(1, pieces)], 0.2 / pieces)
    return sorted({int(c) for c in cuts})


def _chunks(docs: DataFrame, chunk_rows: int) -> Column:
    starts = _chunk_starts(docs.select("doc_id"), chunk_rows)
    if not starts:
        return F.lit(0)
    limits = F.array(*[F.lit(s).cast("bigint") for s in starts])
    # Null ids form the last chunk.
    return F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(limits, lambda s: s <= F.col("doc_id"))))


def with_next(docs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: each document beside the next by descending id.

    The last one's next is the first. The ids are cut into chunks; rows meet their neighbours within chunks in
    one shuffle, and the last row of a chunk gets the first row of the chunk below it, or of the top one.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("__chunk", _chunks(texts, chunk_rows).cast("int"))
    rows = sketch(texts, F.col("text"), "sketch")
    inside = Window.partitionBy("__chunk").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    led = rows.withColumn("__next", F.lead(F.struct("text", "sketch")).over(inside))
    # One row per chunk from here on: its first row, beside the chunk above it.
    tops = texts.groupBy("__chunk").agg(F.max("doc_id").alias("__top"))
    tops = tops.select(F.col("__chunk").alias("__lower"), "__top")
    # At most one row for each of 4096 chunks, so the texts stay where they are.
    firsts = (
        texts.join(F.broadcast(tops), (F.col("__chunk") == F.col("__lower")) & F.col("doc_id").eqNullSafe(F.col("__top")))
        .groupBy("__lower").agg(F.min("text").alias("__text"))
    )
    firsts = sketch(firsts, F.col("__text"), "__sketch")
    upwards = Window.orderBy("__lower")
    above = tops.select(
        "__lower", F.coalesce(F.lead("__lower").over(upwards), F.min("__lower").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__upper")
    )
    heads = firsts.join(above, "__lower").select("__upper", F.struct(F.col("__text").alias("text"), F.col("__sketch").alias("sketch")).alias("__head"))
    joined = led.join(heads, (F.col("__chunk") == F.col("__upper")) & F.col("__next").isNull(), "left")
    after = F.coalesce("__next", "__head")
    return joined.select("doc_id", "text", "sketch", after["text"].alias("next_text"), after["sketch"].alias("next_sketch"))


def fingerprints(docs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are.

    A text of n characters is edited by putting the first floor(n / 3) characters of the next document (or all
    it has) in the place of as many at its end.
    """
    rows = with_next(docs, chunk_rows).withColumn("n_chars", F.length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = rows.withColumn(
        "__edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next_text"), F.lit(1), third))
    )
    both = sketch(edited, F.col("__edited"), "__edited_sketch")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"), written(F.col("__edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("__edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
