"""Tables that streaming jobs update by key, in files any executor can reach.

A commit writes the changed rows of each table as a new version and then one small pointer file, which names
the versions that hold. What a lost job left half-written is not named, and the same batch writes over it; a batch that
was committed is not written again. A row's newest version counts. After `keep` versions a keyed table is
written anew in place, without rows that are gone or retired; a table without keys merges `keep` versions of
one size into a larger one, so that rows are rewritten a few times only. Folders that neither the newest
pointer nor the one before it names are deleted: a reader has until the second commit after it began.

A store belongs to one checkpoint and one writer. Rows are spread by a bucket of their first key and
sorted by it, so that looking up the keys of a batch reads the parts of the files that can hold them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

VERSION, BUCKET, GONE = "version", "__bucket", "gone"
# A smaller table is read whole; finding the buckets of a batch is a job of its own.
PRUNED_BYTES = 64 << 20


@dataclass(frozen=True)
class Table:
    """Rows by key, or rows that are only added (no keys). A true value in a column `gone` deletes a key."""

    keys: tuple[str, ...] = ()
    buckets: int = 64


# What stays of a table's newest rows, and the table that takes the others (none: they go).
Retirement = dict[str, tuple[Column, str | None]]


def hadoop(spark: SparkSession, name: str):
    """A path and the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    path, fs = hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def read_json(spark: SparkSession, name: str):
    path, fs = hadoop(spark, name)
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish_json(spark: SparkSession, name: str, content) -> bool:
    """Write a small document under its name at once, or not at all; false if the name is taken."""
    folder, _, last = name.rpartition("/")
    draft, fs = hadoop(spark, f"{folder}/.{last}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    return bool(fs.rename(draft, hadoop(spark, name)[0]))


class VersionStore:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], keep: int = 8):
        self.spark, self.root, self.tables, self.keep = spark, root.rstrip("/"), tables, keep

    # ---- files ---------------------------------------------------------------------------

    def _path(self, name: str):
        return hadoop(self.spark, f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        return names(self.spark, f"{self.root}/{folder}")

    def _pointers(self) -> list[str]:
        return [n for n in self._names("_pointers") if n.endswith(".json") and not n.startswith((".", "_"))]

    def _read_pointer(self, name: str) -> dict:
        return read_json(self.spark, f"{self.root}/_pointers/{name}")

    def pointer(self) -> dict:
        """The newest commit: its number, its batch, and the versions and schema of every table."""
        names = self._pointers()
        return self._read_pointer(names[-1]) if names else {"number": 0, "batch": [-1, 0], "tables": {}, "schemas": {}}

    def _publish(self, pointer: dict) -> None:
        before = self._pointers()
        name = f"{pointer['number']:012d}.json"
        if not publish_json(self.spark, f"{self.root}/_pointers/{name}", pointer):
            raise RuntimeError(f"{self.root}: another writer has published {name}")
        self._sweep(pointer, before)

    def _sweep(self, pointer: dict, before: list[str]) -> None:
        """Delete what only older pointers name."""
        held = [pointer, *(self._read_pointer(n) for n in before[-1:])]
        for table in self.tables:
            named = {f"{VERSION}={v}" for p in held for v, _ in p["tables"].get(table, [])}
            for folder in self._names(table):
                if folder not in named:
                    path, fs = self._path(f"{table}/{folder}")
                    fs.delete(path, True)
        for name in before[:-1]:
            path, fs = self._path(f"_pointers/{name}")
            fs.delete(path, False)

    def _bytes(self, name: str, versions: list) -> int:
        total = 0
        for version, _ in versions:
            path, fs = self._path(f"{name}/{VERSION}={version}")
            total += fs.getContentSummary(path).getLength()
        return total

    # ---- reading -------------------------------------------------------------------------

    def _versions(self, name: str, versions: list, schema: dict) -> DataFrame:
        full = StructType.fromJson(schema).add(BUCKET, LongType()).add(VERSION, LongType())
        paths = [f"{self.root}/{name}/{VERSION}={v}" for v, _ in versions]
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def newest(self, name: str, like: DataFrame | None = None, touched: DataFrame | None = None) -> DataFrame:
        """Current rows. `like` gives the columns of a table that was never written; with `touched`, a frame
        of some of the keys (the first one among them), only the rows of those keys."""
        pointer, table = self.pointer(), self.tables[name]
        versions = pointer["tables"].get(name)
        if not versions:
            if like is None:
                raise ValueError(f"{self.root}: table {name} was never written")
            return like.filter(F.lit(False))
        schema = pointer["schemas"][name]
        rows = self._versions(name, versions, schema)
        columns = [f["name"] for f in schema["fields"]]
        if touched is not None:
            wanted = touched.distinct()
            if self._bytes(name, versions) > PRUNED_BYTES:
                # At most one number for each bucket.
                buckets = [r[0] for r in touched.select(self._bucket(name)).distinct().collect()]
                rows = rows.filter(F.col(BUCKET).isin(buckets))
            met = [rows[c].eqNullSafe(wanted[c]) for c in wanted.columns]
            test = met[0]
            for m in met[1:]:
                test = test & m
            rows = rows.join(wanted, test, "left_semi")
        if table.keys and len(versions) > 1:
            rest = [c for c in columns if c not in table.keys]
            rows = rows.groupBy(*table.keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(1), VERSION).alias("__row"))
            rows = rows.select(*table.keys, *[F.col(f"__row.{c}").alias(c) for c in rest])
        if GONE in columns:
            rows = rows.filter(~F.coalesce(F.col(GONE), F.lit(False)))
        return rows.select(*columns)

    # ---- writing -------------------------------------------------------------------------

    def _bucket(self, name: str) -> Column:
        table = self.tables[name]
        return F.pmod(F.xxhash64(table.keys[0]), F.lit(table.buckets)).alias(BUCKET) if table.keys else F.lit(0).cast("bigint").alias(BUCKET)

    def _write(self, name: str, number: int, rows: DataFrame) -> None:
        table = self.tables[name]
        placed = rows.select("*", self._bucket(name))
        if table.keys:
            placed = placed.repartition(BUCKET).sortWithinPartitions(BUCKET, *table.keys)
        placed.write.mode("overwrite").parquet(f"{self.root}/{name}/{VERSION}={number}")

    def committed(self, number: int, part: int = 0) -> bool:
        """Was this part of a batch committed before? A batch older than that is none of this store's."""
        newest = self.pointer()["batch"]
        if number < newest[0]:
            raise ValueError(f"{self.root} is ahead of the checkpoint: batch {number} after batch {newest[0]}")
        return [number, part] <= newest

    def commit(
        self, number: int, changes: dict[str, DataFrame], retire: Callable[[VersionStore], Retirement] | None = None, part: int = 0
    ) -> None:
        """Add a batch's changes to all tables at once."""
        if self.committed(number, part):
            return
        pointer = self.pointer()
        pointer["number"] += 1
        pointer["batch"] = [number, part]
        # The tables' jobs run side by side.
        with ThreadPoolExecutor(max(1, len(changes))) as pool:
            list(pool.map(lambda change: self._write(change[0], pointer["number"], change[1]), changes.items()))
        for name, rows in changes.items():
            pointer["tables"].setdefault(name, []).append([pointer["number"], 0])
            pointer["schemas"].setdefault(name, rows.schema.jsonValue())
        self._publish(pointer)
        if any(len(pointer["tables"].get(n, ())) > self.keep for n, t in self.tables.items() if t.keys):
            self.compact(retire)
        self._merge_added()

    def compact(self, retire: Callable[[VersionStore], Retirement] | None = None) -> None:
        """Write the keyed tables anew, one version each."""
        pointer, leaving = self.pointer(), retire(self) if retire else {}
        pointer["number"] += 1
        for name, table in self.tables.items():
            if not table.keys or not pointer["tables"].get(name):
                continue
            rows = self.newest(name)
            stays, into = leaving.get(name, (F.lit(True), None))
            self._write(name, pointer["number"], rows.filter(F.coalesce(stays, F.lit(True))))
            pointer["tables"][name] = [[pointer["number"], 0]]
            if into is not None:
                gone = rows.filter(~F.coalesce(stays, F.lit(True)))
                self._write(into, pointer["number"], gone)
                pointer["tables"].setdefault(into, []).append([pointer["number"], 0])
                pointer["schemas"].setdefault(into, rows.schema.jsonValue())
        self._publish(pointer)

    def _merge_added(self) -> None:
        """Merge the versions of tables without keys, `keep` of one level into one of the next."""
        pointer, changed = self.pointer(), False
        for name, table in self.tables.items():
            versions = pointer["tables"].get(name, [])
            while not table.keys:
                levels = [level for _, level in versions]
                full = next((level for level in sorted(set(levels)) if levels.count(level) >= max(2, self.keep)), None)
                if full is None:
                    break
                merged = [v for v in versions if v[1] == full]
                pointer["number"] += 1
                columns = [f["name"] for f in pointer["schemas"][name]["fields"]]
                self._write(name, pointer["number"], self._versions(name, merged, pointer["schemas"][name]).select(*columns))
                versions = [v for v in versions if v[1] != full] + [[pointer["number"], full + 1]]
                pointer["tables"][name] = versions
                changed = True
        if changed:
            self._publish(pointer)
