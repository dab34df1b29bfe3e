"""File datasets: recorded orders, candle and stream files, and their listings."""

from __future__ import annotations

from datetime import date
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.clock import FILE_STAMP, KST_STAMP, kst_date
from tidebook.schemas import CANDLE_BATCH_FILE, MARKET_CODES, ORDER_RECORD, ORDER_RECORD_FILE, STREAM_FILE
from tidebook.sources.versions import hadoop, names, publish_json, read_json

# Name endings of the document files, <start>_<end>_<kind>.json per market folder.
ORDERS_SUFFIX = "_orders.json"
KIND_SUFFIX = {"batch": "_batch.json", "stream": "_stream.json"}


def _or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    """A folder that was never written is an empty dataset, not an error."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# ---- recorded orders ---------------------------------------------------------------------

def write_order_records(records: DataFrame, root: str, reset: bool) -> None:
    """Write one flush of recorded orders, sorted by time within each market and KST day.

    With `reset` the days it touches are replaced, market by market, otherwise rows are added.
    Rows are spread by range over (market, ts), so one busy market fills many files.
    """
    rows = records.withColumn("trade_date", kst_date(F.timestamp_millis("ts")))
    (
        rows.repartitionByRange("market", "trade_date", "ts").sortWithinPartitions("market", "trade_date", "ts")
        .write.partitionBy("market", "trade_date").mode("overwrite" if reset else "append")
        .option("partitionOverwriteMode", "dynamic").parquet(root)
    )


_FLUSHES = "_flushes"


def _publish_folder(spark: SparkSession, staged: str, target: str, prefix: str, reset: bool) -> None:
    """Move a staged folder's files into the dataset under names of their flush; doing it again changes nothing."""
    if reset:
        for name in names(spark, target):
            if not name.startswith(prefix):
                path, fs = hadoop(spark, f"{target}/{name}")
                fs.delete(path, True)
    folder, fs = hadoop(spark, target)
    fs.mkdirs(folder)
    for name in names(spark, staged):
        if name.endswith(".parquet"):
            fs.rename(hadoop(spark, f"{staged}/{name}")[0], hadoop(spark, f"{target}/{prefix}{name}")[0])


def _publish_flush(spark: SparkSession, root: str, run: str, number: int) -> None:
    """Bring a staged flush into the dataset, as its manifest says, and mark it as done."""
    base = f"{root}/{_FLUSHES}/{run}/{number:08d}"
    manifest = read_json(spark, f"{base}.staged.json")
    for folder in manifest["folders"]:
        reset = folder.split("/")[0] in manifest["reset"]
        _publish_folder(spark, f"{base}.data/{folder}", f"{root}/{folder}", f"{run}-{number:08d}-", reset)
    publish_json(spark, f"{base}.done.json", manifest)
    path, fs = hadoop(spark, f"{base}.data")
    fs.delete(path, True)


def recover_flushes(spark: SparkSession, root: str) -> None:
    """Finish the flushes that were staged whole but not all published; what was staged in part is ignored."""
    for run in names(spark, f"{root}/{_FLUSHES}"):
        found = names(spark, f"{root}/{_FLUSHES}/{run}")
        for name in found:
            number, _, state = name.partition(".")
            if state == "staged.json" and f"{number}.done.json" not in found:
                _publish_flush(spark, root, run, int(number))


def flush_order_records(records: DataFrame, root: str, run: str, number: int) -> set[str]:
    """Flush `number` of a recording run: the first one of each market replaces its days, later ones append.

    The rows are written to a staging folder first, then a manifest names its folders and which markets they
    reset, then files are moved. A flush that broke off anywhere can be repeated, and one that was done is not
    done again: either way there is one copy. Which markets the run has written before follows from its
    manifests, in no process's memory. Rows without a market are left out. Gives the markets written so far.
    """
    spark, root = records.sparkSession, root.rstrip("/")
    if not run or not all(c.isalnum() or c == "-" for c in run):
        raise ValueError("a run's name has letters, digits and hyphens only")
    recover_flushes(spark, root)
    base = f"{root}/{_FLUSHES}/{run}"
    before: set[str] = set()
    for name in names(spark, base):
        if name.endswith(".done.json"):
            before.update(read_json(spark, f"{base}/{name}")["markets"])
    if f"{number:08d}.done.json" not in names(spark, base):
        staged = f"{base}/{number:08d}.data"
        rows = records.filter(F.col("market").isNotNull()).withColumn("trade_date", kst_date(F.timestamp_millis("ts")))
        (
            rows.repartitionByRange("market", "trade_date", "ts").sortWithinPartitions("market", "trade_date", "ts")
            .write.partitionBy("market", "trade_date").mode("overwrite").parquet(staged)
        )
        markets = [m for m in names(spark, staged) if m.startswith("market=")]
        folders = [f"{m}/{d}" for m in markets for d in names(spark, f"{staged}/{m}")]
        publish_json(spark, f"{base}/{number:08d}.staged.json", {
            "markets": markets, "reset": [m for m in markets if m not in before], "folders": folders,
        })
        _publish_flush(spark, root, run, number)
        before.update(markets)
    return {unquote(m.removeprefix("market=")) for m in before}


def read_order_records(spark: SparkSession, root: str, market: str | None = None, day: str | date | None = None) -> DataFrame:
    """Recorded orders; market and day prune whole folders."""
    rows = _or_empty(lambda: spark.read.schema(ORDER_RECORD).parquet(root), spark, ORDER_RECORD)
    if market is not None:
        rows = rows.filter(F.col("market") == market)
    if day is not None:
        rows = rows.filter(F.col("trade_date") == F.lit(str(day)).cast("date"))
    return rows


def read_order_documents(spark: SparkSession, root: str) -> DataFrame:
    """Recorded orders from nested JSON documents (<market>/<start>_<end>_orders.json)."""
    def read():
        return (
            spark.read.schema(ORDER_RECORD_FILE).option("multiLine", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", f"*{ORDERS_SUFFIX}").json(root)
        )

    documents = _or_empty(read, spark, ORDER_RECORD_FILE)
    exploded = documents.select("market", F.posexplode("orders").alias("position", "o"))
    return exploded.select(
        "market", "position", "o.ts", "o.side", "o.price", "o.quantity", F.col("o.orderId").alias("order_id")
    )


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths below `root`; file contents are not read."""
    def read():
        return (
            spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(root).select("path")
        )

    return _or_empty(read, spark, "path string")


def _kst_day(path: Column) -> Column:
    """KST date of a path: from its trade_date folder, else from the start stamp of its name.

    Stamps with Z are UTC (recorded orders), those without are KST (candles and streams).
    """
    stamp = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^([^_]*)_", 1)
    folder = F.nullif(F.regexp_extract(path, r"/trade_date=(\d{4}-\d{2}-\d{2})/", 1), F.lit(""))
    utc = kst_date(F.try_to_timestamp(stamp, F.lit(FILE_STAMP)))
    return F.coalesce(folder.cast("date"), utc, F.try_to_timestamp(stamp, F.lit(KST_STAMP)).cast("date"))


def replay_dates(paths: DataFrame) -> DataFrame:
    """KST dates that have recorded orders, newest first, from the paths of documents or of written folders."""
    path = F.col("path")
    orders = path.endswith(ORDERS_SUFFIX) | (path.contains("/trade_date=") & path.endswith(".parquet"))
    named = paths.filter(orders).select(_kst_day(path).alias("d"))
    dated = named.filter(F.col("d").isNotNull()).distinct()
    return dated.select(F.date_format("d", "yyyy-MM-dd").alias("date")).orderBy(F.desc("date"))


# ---- market files ------------------------------------------------------------------------

def build_candle_batch(candles: dict[str, DataFrame]) -> DataFrame:
    """One document per market with the candle arrays of days, weeks, months and years.

    The arrays are bounded by the calendar: one element per day at most.
    """
    units = ("days", "weeks", "months", "years")
    merged = None
    for unit in units:
        rows = candles[unit].select(
            "market_code", F.lit(unit).alias("unit"),
            F.struct((F.col("start") * 1000).alias("ts"), "open", "high", "low", "close", "volume").alias("candle"),
        )
        merged = rows if merged is None else merged.unionByName(rows)
    arrays = [
        F.sort_array(F.collect_list(F.when(F.col("unit") == unit, F.col("candle")))).alias(unit) for unit in units
    ]
    return merged.groupBy("market_code").agg(*arrays).select(
        F.col("market_code").alias("market"), F.struct(*units).alias("candles")
    )


def with_range(documents: DataFrame, start: str, end: str) -> DataFrame:
    """Add the KST range header of a document."""
    span = F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"))
    return documents.withColumn("range", span)


def write_documents(documents: DataFrame, root: str, kind: str, day: str) -> None:
    """Write documents as JSON below kind=<kind>/market=<market>/trade_date=<day>."""
    (
        documents.withColumns({"kind": F.lit(kind), "folder": F.col("market"), "trade_date": F.lit(day)})
        .write.partitionBy("kind", "folder", "trade_date").mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").json(root)
    )


def _documents(spark, root, schema, kind, market, day) -> DataFrame:
    full = f"{schema}, kind string, folder string, trade_date string"
    rows = _or_empty(lambda: spark.read.schema(full).json(root), spark, full).filter(F.col("kind") == kind)
    if market is not None:
        rows = rows.filter(F.col("folder") == market)
    if day is not None:
        rows = rows.filter(F.col("trade_date") == str(day))
    return rows


def explode_batch(documents: DataFrame) -> DataFrame:
    """Long candle table of batch documents."""
    def tagged(unit):
        return F.transform(F.col(f"candles.{unit}"), lambda c: F.struct(F.lit(unit).alias("unit"), c.alias("c")))

    candles = F.flatten(F.array(*[tagged(unit) for unit in ("days", "weeks", "months", "years")]))
    rows = documents.select("market", F.explode(candles).alias("e"))
    return rows.select("market", "e.unit", "e.c.*")


def explode_stream(documents: DataFrame) -> DataFrame:
    return documents.select("market", F.explode("events").alias("e")).select("market", "e.*")


def read_candle_batch(spark: SparkSession, root: str, market: str | None = None, day: str | None = None) -> DataFrame:
    return explode_batch(_documents(spark, root, CANDLE_BATCH_FILE, "batch", market, day))


def read_market_documents(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Candle (`batch`) or event (`stream`) rows of nested documents named by market and range."""
    schema, explode = (CANDLE_BATCH_FILE, explode_batch) if kind == "batch" else (STREAM_FILE, explode_stream)

    def read():
        return (
            spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", f"*{KIND_SUFFIX[kind]}").json(root)
        )

    return explode(_or_empty(read, spark, schema))


STREAM_ROWS = (
    "market string, trade_date date, type string, ts bigint, open double, high double, low double, close double, "
    "volume double, price double, side string"
)


def write_stream_rows(stream: DataFrame, root: str) -> None:
    """Market stream rows in time order, by market and KST day; one row per event."""
    rows = stream.withColumn("trade_date", kst_date(F.timestamp_millis("ts"))).withColumnRenamed("market_code", "market")
    (
        rows.repartitionByRange("market", "trade_date", "ts").sortWithinPartitions("market", "trade_date", "ts")
        .write.partitionBy("market", "trade_date").mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").json(root)
    )


def read_stream_rows(spark: SparkSession, root: str, market: str | None = None, day: str | date | None = None) -> DataFrame:
    rows = _or_empty(lambda: spark.read.schema(STREAM_ROWS).json(root), spark, STREAM_ROWS)
    if market is not None:
        rows = rows.filter(F.col("market") == market)
    if day is not None:
        rows = rows.filter(F.col("trade_date") == F.lit(str(day)).cast("date"))
    return rows


# ---- coverage ----------------------------------------------------------------------------

def stored_days(paths: DataFrame) -> DataFrame:
    """(market, date, kind) of document paths <market>/<start>_<end>_<kind>.json and of written folders.

    Written folders are kind=<kind>/folder=<market>/trade_date=<date> for documents, and
    market=<market>/trade_date=<date> for stream rows (JSON) and recorded orders (parquet).
    """
    path = F.col("path")
    taken = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    market = F.coalesce(taken(r"(?:^|/)(?:folder|market)=([^/]*)/"), F.element_at(F.split(path, "/"), -2))
    rows = F.when(path.rlike("(^|/)market="), F.when(path.rlike(r"\.json(\.[a-z0-9]+)?$"), "stream").otherwise("orders"))
    kind = F.coalesce(taken(r"(?:^|/)kind=([^/]*)/"), rows, taken(r"_([a-z]+)\.json$"))
    return paths.select(market.alias("market_code"), _kst_day(path).alias("trade_date"), kind.alias("kind")).distinct()


def dataset_coverage(dates: DataFrame, stored: DataFrame) -> DataFrame:
    """Per market of the dimension and wanted date: do the batch and stream files exist?"""
    markets = F.explode(F.array(*[F.lit(code) for code in MARKET_CODES]))
    wanted = dates.select(
        markets.alias("market_code"), "trade_date", F.lit(True).alias("wanted"),
        F.lit(False).alias("batch"), F.lit(False).alias("stream"),
    )
    found = stored.select(
        "market_code", "trade_date", F.lit(False).alias("wanted"),
        (F.col("kind") == "batch").alias("batch"), (F.col("kind") == "stream").alias("stream"),
    )
    merged = wanted.unionByName(found).groupBy("market_code", "trade_date").agg(
        *[F.bool_or(c).alias(c) for c in ("wanted", "batch", "stream")]
    )
    return merged.filter("wanted").select(
        "market_code", "trade_date", F.col("batch").alias("batch_exists"), F.col("stream").alias("stream_exists"),
        (F.col("batch") & F.col("stream")).alias("all_exist"),
    )


def collect_outcome(results: DataFrame) -> DataFrame:
    """How many collection jobs ended ok and with an error, per day."""
    return results.groupBy("trade_date").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("error")
    )
