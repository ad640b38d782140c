"""Exact deduplication as a stateful stream: keyed state on disk, without expiry, and full bytes compared on hits.

Two exactly-once streams share a folder. The first reads new files once and writes an arrival for each row: its id, its
length in code points, the sha256 of its text without white space, and a locator (file and row number) that says where the
text can be found again. The second keeps one entry of RocksDB state for each digest: how many rows bore it, and the id and
locator of the row that stays. It is an aggregation, so rows of one digest are combined where they were read and a hot
digest reaches its state as one row from each task; each micro-batch writes the entries that it changed.

A digest that comes again is a hit. The rows of such digests are fetched by their locators (their texts alone move, each
under a key of its own) and the smallest and largest bytes of a digest are compared; where they differ, the digest is
grouped anew by whole texts, so that a collision costs time but no document. A later call on the same folder reads new files
only and returns the rows of all.

Defined results: a null text is empty, and empty texts equal each other and texts of white space; of rows of equal length
and doc_id (null ids last) the one of the first locator stays, one row in each group; repeated ids and rows are rows of their
own; an empty table gives no rows. A text is held whole by the task that hashes it. Extra columns are left alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

#: Bytes of source files that one micro-batch takes.
BATCH_BYTES = 1 << 40
#: Rows for each partition of the state at its first start (8 partitions at least), which fixes their number: each is a database of its own,
#: of some 4 MB when empty and about 200 bytes a digest.
STATE_ROWS = 1_000_000
_ROW = "doc_id long, chars int, sha256 binary, file string, row long"
_STATE_PARTITIONS = "spark.sql.streaming.internal.stateStore.partitions"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(text: Column) -> Column:
    """The text without the characters x20 and x09 to x0D; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def keeper() -> Column:
    """Smallest for the row that stays: most code points, then smallest doc_id, then first locator."""
    return F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")


def _files(spark: SparkSession, path: str, batch_bytes: int) -> DataFrame:
    """The files of a Parquet folder, or a single file, as a stream. A pattern, as a stream's own path must be a folder; files never age."""
    stream = spark.readStream.schema(spark.read.parquet(path).select("doc_id", "text").schema)
    stream = stream.option("maxFileAge", "36500d").option("maxBytesPerTrigger", batch_bytes)
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")


def arrivals(spark: SparkSession, source: str, store: str, batch_bytes: int = BATCH_BYTES) -> None:
    """Stream what is new in ``source`` into ``store``/arrivals."""
    rows = _files(spark, source, batch_bytes).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).alias("chars"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha256"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{store}/arrivals-log").trigger(availableNow=True)
    writer.start(f"{store}/arrivals").awaitTermination()


def entries(spark: SparkSession, store: str, key: Callable[[Column], Column], state_partitions: int, batch_bytes: int = BATCH_BYTES) -> None:
    """Pass new arrivals through the state; each micro-batch writes the entries it changed to ``store``/entries."""
    session = spark.newSession()  # the state's settings stay there
    for k, v in (_STATE | {_STATE_PARTITIONS: state_partitions}).items():
        session.conf.set(k, v)
    new = session.readStream.schema(_ROW).option("maxFileAge", "36500d").option("maxBytesPerTrigger", batch_bytes).parquet(f"{store}/arrivals")
    state = new.groupBy(key(F.col("sha256")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(keeper()).alias("keeper"))

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{store}/entries/batch={batch}")  # a repeated batch replaces itself

    writer = state.writeStream.outputMode("update").option("checkpointLocation", f"{store}/entries-log").trigger(availableNow=True)
    writer.foreachBatch(save).start().awaitTermination()


def latest(spark: SparkSession, store: str) -> DataFrame:
    """(key, n, keeper) of every digest: counts only grow, so the largest is the latest."""
    kind = "key binary, n long, keeper struct<less:int,no_id:boolean,doc_id:long,file:string,row:long>, batch long"
    rows = spark.read.schema(kind).parquet(f"{store}/entries")
    return rows.groupBy("key").agg(F.max(F.struct("n", "batch", "keeper")).alias("e")).select("key", "e.n", "e.keeper")


def contents(spark: SparkSession, source: str, wanted: DataFrame) -> DataFrame:
    """Adds ``text``, normalised, to rows with locators. A bit table keeps other rows of the source where they are."""
    at = F.xxhash64("file", "row")
    docs = spark.read.parquet(source).select("text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    ids = wanted.select(at.alias("at")).distinct()
    near = frames.marked(docs.withColumn("at", at), "at", ids).filter("_hit").select("file", "row", normalised(F.col("text")).alias("text"))
    return wanted.join(near, ["file", "row"])


def collided(hits: DataFrame) -> DataFrame:
    """Keys of which not all texts have the same bytes. ``hits``: (key, text)."""
    ends = hits.groupBy("key").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return ends.filter("low != high").select("key")


def deduplicated(spark: SparkSession, source: str, store: str | None = None, key: Callable[[Column], Column] = lambda sha256: sha256, batch_bytes: int = BATCH_BYTES, state_partitions: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, file, row) of every row of the Parquet files at ``source``.

    ``store`` is a folder that driver and executors share and that keeps the streams' state between calls; without one, a new folder
    in ``spark.checkpoint.dir`` is taken. ``key`` makes the state's key of a sha256; one that collides gives the same result.
    """
    store = store or f"{frames.shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
    if spark.read.parquet(source).isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, file string, row long")
    arrivals(spark, source, store, batch_bytes)
    rows = spark.read.schema(_ROW).parquet(f"{store}/arrivals").withColumn("key", key(F.col("sha256")))
    entries(spark, store, key, state_partitions or max(8, rows.count() // STATE_ROWS), batch_bytes)
    known = frames.stored(latest(spark, store), "entries")
    again = frames.stored(rows.join(known.filter("n > 1").select("key"), "key", "left_semi"), "hits")
    hits = contents(spark, source, again)
    odd = frames.stored(collided(hits), "collided")
    names = [*rows.columns, "n", "keeper"]
    joined = rows.join(known, "key").select(*names)
    if not odd.isEmpty():
        texts = frames.stored(contents(spark, source, again.join(odd, "key", "left_semi")), "texts")
        groups = texts.groupBy("key", "text").agg(F.count(F.lit(1)).alias("n"), F.min(keeper()).alias("keeper"))
        joined = joined.join(odd, "key", "left_anti").unionByName(texts.join(groups, ["key", "text"]).select(*names))
    stays = (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))
    return joined.select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"), "file", "row"
    )


def op11_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark, f"{sf_dir}/documents.parquet").drop("file", "row")


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size, row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
FROM t WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id NULLS LAST)
"""
