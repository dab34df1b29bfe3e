"""Fixity audit of WARC archives by Merkle trees.

Records lie in volumes, one after the other; a record's hash covers its bytes. Leaves are ranges of FANOUT ids;
a leaf hashes its records' digests, lengths and numbers of copies in order, which fix their offsets inside the
range. Parents hash their children's numbers, hashes and lengths, and so on up to one root per volume; volumes
then form a tree of their own up to the archive's root. Ranges are fixed by ids and offsets count from a
range's begin, so a lost, added or shortened record changes its own range and those above it only. Two
replicas compare roots and descend only into branches that differ, so equal branches cost one comparison at
their top.

Null addresses and bodies count as empty. Records of one id are told apart by their bytes and stored in that
order; equal ones are stored each. Null ids have ranges by their digests, and as nothing else tells which is
which, a damaged one is missing and another one extra. An empty archive has no root; against it all records of
the other are missing. Extra columns do not matter. Records of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.session import cut

VOLUME_IDS = 4096  # consecutive ids that share a volume
VOLUME_ROWS = 8192  # volumes with more distinct records than this are divided
FANOUT = 16
HEIGHT = 3  # levels above the ids: FANOUT ** HEIGHT = VOLUME_IDS


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A response record as WARC 1.0 writes it."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame) -> DataFrame:
    """record_id, digest, n_bytes of each page's record."""
    page_id = F.col("page_id").cast("bigint")
    made = pages.select(page_id.alias("record_id"), record_bytes(page_id, F.col("url").cast("string"), F.col("html").cast("string")).alias("__bytes"))
    return made.select("record_id", F.sha2("__bytes", 256).alias("digest"), F.octet_length("__bytes").cast("bigint").alias("n_bytes"))


def _volume() -> Column:
    return F.coalesce(F.expr(f"record_id div {VOLUME_IDS}"), F.lit(-1).cast("bigint")).alias("volume")


def leaves(recorded: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """volume, part, slot, position, record_id, digest, n_bytes, copies, offset: distinct records in their places.

    A volume with too many records, different ones of one id say, is divided by hash of the id and bytes. Two
    replicas have one layout, which gives each volume's number of parts. Position and offset are those of a
    record's first copy in its volume or part.
    """
    layout = layout if layout is not None else volume_layout(recorded)
    rows = recorded.groupBy("record_id", "digest", "n_bytes").agg(F.count(F.lit(1)).alias("copies")).withColumn("volume", _volume())
    rows = rows.join(layout, "volume", "left").select(
        "volume", F.pmod(F.xxhash64("record_id", "digest"), F.coalesce("parts", F.lit(1)).cast("bigint")).alias("part"),
        F.pmod(F.coalesce("record_id", F.xxhash64("digest")), F.lit(VOLUME_IDS)).alias("slot"), "record_id", "digest", "n_bytes", "copies",
    )
    before = Window.partitionBy("volume", "part").orderBy("slot", "record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0).cast("bigint"))
    return rows.withColumns({"position": count("copies"), "offset": count(F.col("n_bytes") * F.col("copies"))})


def volume_layout(*recorded: DataFrame) -> DataFrame:
    """volume, parts of the volumes that are divided, by the largest of the replicas."""
    counts = [r.select("record_id", "digest").distinct().groupBy(_volume()).count() for r in recorded]
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("volume").agg(F.ceil(F.max("count") / VOLUME_ROWS).cast("bigint").alias("parts")).filter("parts > 1")


def _parents(nodes: DataFrame, children: list[str]) -> DataFrame:
    """Nodes one level up: FANOUT children in order; the hash covers what is named of them, which fixes their offsets."""
    listed = F.sort_array(F.collect_list(F.struct(*children)))
    return nodes.groupBy("volume", "part", F.expr(f"node div {FANOUT}").alias("node")).agg(
        F.sha2(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", *[x[c] for c in children])), "|"), 256).alias("hash"),
        F.sum("bytes").cast("bigint").alias("bytes"),
    )


def levels(rows: DataFrame) -> list[DataFrame]:
    """Trees of all volumes, level by level from ranges of FANOUT ids up to one root each."""
    level = rows.select("volume", "part", F.col("slot").alias("node"), "record_id", F.col("digest").alias("hash"), "n_bytes", "copies", (F.col("n_bytes") * F.col("copies")).alias("bytes"))
    made = [cut(_parents(level, ["node", "record_id", "hash", "n_bytes", "copies"]), rows.sparkSession)]
    while len(made) < HEIGHT:
        made.append(cut(_parents(made[-1], ["node", "hash", "bytes"]), rows.sparkSession))
    return made


def root(volume_roots: DataFrame) -> str | None:
    """The archive's root over its volumes in order; volumes are numbered and joined run by run."""
    # Volumes are few beside records; they are still hashed level by level, by ranges of their numbers.
    hashed = volume_roots.select(
        F.expr("volume div 16").alias("node"), F.struct("volume", "part", "hash", "bytes").alias("c")
    ).groupBy("node").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("c"))), 256).alias("hash"))
    while True:
        sizes = hashed.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        if sizes == 0:
            return None
        if sizes == 1:
            return hashed.first()["hash"]
        # The shift gathers -1 and 0 as well.
        hashed = cut(
            hashed.select(F.when(F.col("node") < 0, 0).otherwise(F.expr("node div 16")).cast("bigint").alias("up"), F.struct("node", "hash").alias("c"))
            .groupBy("up").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("c"))), 256).alias("hash")).withColumnRenamed("up", "node"),
            volume_roots.sparkSession,
        )


def audit(archive: DataFrame, replica: DataFrame) -> DataFrame:
    """Records in which a replica differs from the archive, found by descending unequal branches.

    Both are tables of (record_id, digest, n_bytes). Columns: volume, part, position, record_id, replica_id,
    offset, n_bytes, digest, replica_digest, state: altered, missing (no record in the replica) or extra. Records
    of one id that only one side has are altered pair by pair, in the order of their digests; what is left over
    is missing or extra. Position is the archive's, an extra record's is the replica's; copies have one row each.
    """
    spark = archive.sparkSession
    layout = cut(volume_layout(archive, replica), spark)
    mine, theirs = cut(leaves(archive, layout), spark), cut(leaves(replica, layout), spark)
    trees = levels(mine), levels(theirs)
    keys = ["volume", "part", "node"]
    suspects = None
    if root(trees[0][-1]) == root(trees[1][-1]):
        suspects = trees[0][-1].filter("false").select("volume", "part", F.col("node").alias("up"))
    for a, b in list(zip(*trees, strict=True))[::-1]:
        if suspects is not None:
            a, b = (x.withColumn("up", F.expr(f"node div {FANOUT}")).join(suspects, ["volume", "part", "up"], "left_semi").drop("up") for x in (a, b))
        left, right = a.select(*keys, F.struct("hash", "bytes").alias("x")), b.select(*keys, F.struct("hash", "bytes").alias("y"))
        unequal = left.join(right, keys, "full").filter(~F.col("x").eqNullSafe(F.col("y")))
        suspects = cut(unequal.select("volume", "part", F.col("node").alias("up")), spark)

    def under(rows: DataFrame, name: str) -> DataFrame:
        near = rows.withColumn("up", F.expr(f"slot div {FANOUT}")).join(suspects, ["volume", "part", "up"], "left_semi")
        return near.select("volume", "part", "record_id", "digest", "n_bytes", F.struct("position", "offset", "copies").alias(name))

    # A digest covers the id, so equal digests are equal records.
    sides = under(mine, "a").unionByName(under(theirs, "b"), allowMissingColumns=True)
    met = sides.groupBy("volume", "part", "record_id", "digest", "n_bytes").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    has = lambda side: F.coalesce(F.col(f"{side}.copies"), F.lit(0))

    def only(side: str, other: str) -> DataFrame:
        """One row for each copy that `side` has beyond the other."""
        rows = met.filter(has(side) > has(other)).withColumn("copy", F.explode(F.sequence(has(other), has(side) - 1)))
        return rows.select(
            "volume", "part", "record_id", "digest", "n_bytes",
            (F.col(f"{side}.position") + F.col("copy")).alias("position"), (F.col(f"{side}.offset") + F.col("copy") * F.col("n_bytes")).alias("offset"), "copy",
        )

    def numbered(rows: DataFrame, prefix: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("record_id").orderBy("digest", "copy"))
        named = rows.filter("record_id is not null").withColumn("nth", nth)
        # Null ids have no pair, so they are not numbered.
        rows = named.unionByName(rows.filter("record_id is null").withColumn("nth", F.lit(None).cast("int")))
        return rows.select(*[F.col(c).alias(prefix + c) for c in ("volume", "part", "record_id", "nth", "position", "digest", "n_bytes", "offset")])

    lost, found = numbered(only("a", "b"), "a_"), numbered(only("b", "a"), "b_")
    both = lost.join(found, (F.col("a_record_id") == F.col("b_record_id")) & (F.col("a_nth") == F.col("b_nth")), "full")
    state = F.when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest").isNull(), "extra").otherwise("altered")
    return both.select(
        *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in ("volume", "part", "position")], F.col("a_record_id").alias("record_id"),
        F.col("b_record_id").alias("replica_id"), F.col("a_offset").alias("offset"), F.col("a_n_bytes").alias("n_bytes"),
        F.col("a_digest").alias("digest"), F.col("b_digest").alias("replica_digest"), state.alias("state"),
    )


def fading_replica(pages: DataFrame) -> DataFrame:
    """A replica of the pages in which of about a hundred records one has lost its last character, one is lost and one is added.

    Which ones depends on a checksum of the id, so that an audit can be checked; empty bodies get a blank. The
    added record has the id and body of the one before it and an address of its own.
    """
    chance = F.coalesce(F.pmod(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(97)), F.lit(-1))
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    changed = F.when(F.length(body) == 0, F.lit(" ")).otherwise(F.substring(body, F.lit(1), F.length(body) - 1))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    times = F.when(chance == 2, F.array(F.lit(""), F.lit("#again"))).otherwise(F.array(F.lit("")))
    kept = pages.withColumns({"html": F.when(chance == 0, changed).otherwise(body), "__again": F.explode(times)}).filter(chance != 1)
    return kept.withColumn("url", F.concat(url, F.col("__again"))).drop("__again")
