"""Writing: the ledger, documents, verdicts, certificates and the inference log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.documents import unseen
from ..operators.ingest import loaded, with_ids


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def stream_into(rows: DataFrame, path: str, checkpoint: str, made: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None, form: str = "parquet") -> None:
    """Write a stream's micro-batches exactly once, as partitions ``batch=<id>`` of the table at ``path``; returns when all there is has been written.

    A batch that is repeated after a failure replaces what it wrote before, and no other partition. ``made``, if given, makes a batch's rows
    from what arrived and from the table as earlier batches left it (None before the first), so that ids and skipped rows come out the same
    when it is repeated.
    """

    def write(arrived: DataFrame, batch: int) -> None:
        spark = arrived.sparkSession
        out = arrived
        if made is not None:
            out = made(arrived, spark.read.parquet(path).filter(F.col("batch") < batch).drop("batch") if batch else None)
        out.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").format(form).save(path)

    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def stream_documents(docs: DataFrame, path: str, checkpoint: str) -> None:
    """``put_documents`` for a stream of (digest, path, route, read_at): each digest once, with consecutive ids."""

    def new(arrived: DataFrame, stored: DataFrame | None) -> DataFrame:
        known = arrived.sparkSession.createDataFrame([], "id bigint, digest string") if stored is None else stored
        return with_ids(unseen(arrived, known), ["digest"], known, "id").select("id", "digest", "path", "route", "read_at")

    stream_into(docs, path, checkpoint, new)


def import_rows(rows: DataFrame, vendors: DataFrame, records: DataFrame, staging: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write new vendors and records to a staging folder, to be moved into place together; returns what was written and skipped.

    All three are read back from what was written, so that ids are settled once.
    """
    spark = rows.sparkSession
    out = []
    for name, df in zip(("vendors", "records", "skipped"), loaded(rows, vendors, records), strict=True):
        df.write.mode("overwrite").parquet(f"{staging}/{name}")
        out.append(spark.read.schema(df.schema).parquet(f"{staging}/{name}"))
    return tuple(out)


def put_documents(docs: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """Append documents of new digests with ids; known ones stay as they are."""
    new = with_ids(unseen(docs, known), ["digest"], known, "id").select("id", "digest", "path", "route", "read_at")
    append(new, path)
    return new


def put_reconciliations(verdicts: DataFrame, known: DataFrame, path: str) -> None:
    """Append verdicts with their ordered checks in one row; earlier ones are kept."""
    rows = verdicts.select(F.col("doc_id").alias("document_id"), "record_id", "decision", F.col("variance_minor").alias("variance"), F.current_timestamp().alias("computed_at"), "checks")
    append(with_ids(rows, ["document_id"], known, "id"), path)


def write_certificates(certificates: DataFrame, path: str) -> None:
    """One JSON line for each certificate."""
    certificates.select(F.col("certificate").alias("value")).write.mode("append").text(path)


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)
