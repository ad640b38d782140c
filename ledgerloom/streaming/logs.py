"""The inference log as a stream, and documents arriving with repeats.

The same transformations run on a batch of the same rows; tests hold one against the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INFERENCE_LOG


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(INFERENCE_LOG).option("maxFilesPerTrigger", files_per_trigger).json(path)


def by_window(log: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Calls, failures, total and mean time of each operation and model in windows of time."""
    spent = F.coalesce("gen_ms", "ocr_ms", "load_ms")
    rows = log.withColumn("ms", spent)
    if log.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "op", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.count("error").alias("failures"), F.sum("ms").alias("total_ms"), F.avg("tok_per_sec").alias("tok_per_sec")
    )
    return out.select(F.col("w.start").alias("start"), "op", "model", "calls", "failures", "total_ms", "tok_per_sec")


def first_arrivals(docs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Documents (digest, read_at, ...) whose digest has not arrived before, within the watermark when streaming."""
    if docs.isStreaming:
        return docs.withWatermark("read_at", late).dropDuplicatesWithinWatermark(["digest"])
    return docs.dropDuplicates(["digest"])
