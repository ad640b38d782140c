"""Files by content: digests, search by digest, JSON regions and whole-file JSON texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import BOX
from ..functions.hashing import digest


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, digest) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", digest(F.col("content")).alias("digest"))


def find_by_digest(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Files whose content has one of the wanted digests."""
    return digests(spark, path).join(wanted.select("digest").distinct(), "digest", "left_semi")


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, certificate): whole JSON files as they are, for hashing as well as parsing."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("certificate"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Recognised regions, one JSON array for each page file."""
    kind = "array<struct<text:string,bbox:array<double>,confidence:double,source:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.json)?$", 1).alias("doc_id"), F.posexplode(F.from_json("value", kind)).alias("idx", "r"))
    b = F.col("r.bbox")
    box = F.when(F.size(b) == 4, F.struct(b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1"))).cast(BOX)
    return rows.select("doc_id", "idx", "r.text", box.alias("bbox"), "r.confidence", "r.source")
