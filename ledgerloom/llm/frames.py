"""Small helpers shared by the operators: held-out split, sampling, shared-folder tables, UDF batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch for columns of whole texts; bounds a worker's memory.
TEXT_BATCH_ROWS = 500
#: Rows of one key and salt (about): the size of a ranking group.
SALT_ROWS = 20_000


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Keep Arrow batches of texts small (at most ``rows`` rows and 16 MB)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


_own_dirs: dict[str, str] = {}
_tables: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is taken if driver and tasks are one process (a local master); a cluster must set it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found and app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="ledgerloom-")
    return (found or _own_dirs[app]).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and later reads take only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def tables_stored(spark: SparkSession) -> int:
    """How many tables ``stored`` has written for this application and not deleted."""
    return len(_tables.get(spark.sparkContext.applicationId, []))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(table: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    _tables[table.sparkSession.sparkContext.applicationId].remove(table.stored_at)
    _delete(table.sparkSession, table.stored_at)


def drop_stored(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the tables that ``stored`` wrote for this application, from the ``since``-th on and but for ``keep``, once their results are written elsewhere."""
    tables = _tables.get(spark.sparkContext.applicationId, [])
    paths = [x for x in tables[since:] if keep is None or x != keep.stored_at]
    for path in paths:
        tables.remove(path)
        _delete(spark, path)
    return len(paths)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that no model learns from; a null id is not held out."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) != 2, F.lit(False))


def share(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the key: ``share < k / n`` draws about k of n rows, the same each run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def labelled_sample(labels: DataFrame, label: str, per_class: int, seed: int = 11) -> DataFrame:
    """About ``per_class`` learnable ids of each class of the 0/1 column ``label``: (doc_id, y, w).

    ``w`` is the number of labelled ids that a drawn one stands for: 1 while its class is taken whole. Ids labelled more than once take the largest label; the row count is bounded by 2 * per_class
    (up to the spread of a binomial draw), whatever the table's size.
    """
    one = (
        labels.filter(F.col(label).isin(0, 1) & learnable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep, w = F.lit(False), F.lit(1.0)
    for y, n in counts.items():
        keep = keep | ((F.col("y") == y) & (share(F.col("doc_id"), seed) < per_class / n))
        w = F.when(F.col("y") == y, max(1.0, n / per_class)).otherwise(w)
    return one.filter(keep).withColumn("w", w)


def sampled_docs(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The documents of a bounded id sample; the sample is small by construction, so it is broadcast."""
    return docs.join(F.broadcast(sample), "doc_id")


def bounded(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df``, marked for broadcasting if it has ``rows`` rows at most; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free(df: DataFrame, *names: str) -> list[str]:
    """For each name, one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def marked(df: DataFrame, key: str, ids: DataFrame, bits_per_id: int = 10, max_bits: int = 1 << 28, hit: str = "_hit") -> DataFrame:
    """Adds ``hit``, a name that no column has: false only where ``key`` is surely not among ``ids`` (one column of that name, distinct, not null).

    A bit table of the ids, at most ``max_bits`` / 8 bytes (32 MB) whatever the input, is broadcast in slices of 4 KB.
    """
    n = ids.count()
    bits = 1 << 15
    while bits < min(max_bits, bits_per_id * n):
        bits *= 2
    p = F.pmod(F.xxhash64(F.col(key), F.lit(77)), F.lit(bits))
    part, held = free(df, "_slice", "_bits")
    marks = ids.select((p % 32768).alias("_p"), F.floor(p / 32768).cast("long").alias(part))
    marks = marks.groupBy(part).agg(F.bitmap_construct_agg("_p").alias(held))
    byte = F.conv(F.hex(F.col(held).substr(F.floor((p % 32768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.floor(byte / F.pow(F.lit(2.0), p % 8)) % 2 == 1, F.lit(False))
    joined = df.join(F.broadcast(marks), F.floor(p / 32768).cast("long") == F.col(part), "left")
    return joined.withColumn(hit, found).drop(part, held)


def drop_ids(df: DataFrame, key: str, ids: DataFrame, once: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids``; of those in ``once`` one row for each key.

    Rows that the bit table of both clears stay where they are; only the others are joined.
    """
    (hit,) = free(df, "_hit")
    rows = marked(df, key, ids.union(once).distinct(), hit=hit)
    near = rows.filter(F.col(hit)).drop(hit).join(ids, key, "left_anti")
    twice = near.join(once, key, "left_semi").dropDuplicates([key])
    return rows.filter(~F.col(hit)).drop(hit).unionByName(near.join(once, key, "left_anti")).unionByName(twice)


def numbered(rows: DataFrame, key: str, again: DataFrame, name: str, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Adds ``name``: 0, 1, ... among the rows of one ``key``; ``again`` holds the keys of several rows (one column of that name, not null).

    Only rows whose key may be among ``again`` move. They are stored with a number of their own, whose hash salts them, so
    that one key's rows are ranked over many tasks.
    """
    if again.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    near = marked(rows, key, again)
    hit = stored(near.filter("_hit").drop("_hit").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    salts = max(1, -(-hit.count() // salt_rows))
    hit = hit.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(salts)).cast("int"))
    counts = hit.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_salt")) - F.col("_n")
    starts = counts.select(key, "_salt", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_salt").orderBy("_at")) - 1
    ranked = hit.withColumn("_within", within).join(starts, [key, "_salt"]).withColumn(name, F.col("_before") + F.col("_within"))
    return near.filter("not _hit").drop("_hit").withColumn(name, F.lit(0).cast("long")).unionByName(ranked.select(*rows.columns, name))


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds the sum of each of ``sums`` over all rows up to and including a row, in the given order (of which no two rows are equal).

    Rows are range-sorted and stored; a partition's rows are summed up by themselves, and what is before a partition comes from
    the sums of the partitions, one row each. So no task sees all rows.
    """
    values = rows.withColumns({f"_{k}": v for k, v in sums.items()})
    values = stored(values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "running")
    parts = values.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    up_to = Window.orderBy("_part")  # one row for each partition
    parts = parts.select(F.col("_part").alias("_before"), *[(F.sum(f"_{k}").over(up_to) - F.col(f"_{k}")).alias(f"_b{k}") for k in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = values.select("*", *[F.sum(f"_{k}").over(within).alias(f"_w{k}") for k in sums]).join(F.broadcast(parts), F.col("_part") == F.col("_before"))
    return out.select(*rows.columns, *[(F.col(f"_b{k}") + F.col(f"_w{k}")).alias(k) for k in sums])
