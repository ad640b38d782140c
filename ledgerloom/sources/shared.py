"""Tables in the folder that driver and executors share: they cut a plan's lineage and outlive a lost executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder if driver and tasks are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found and app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="ledgerloom-")
    return (found or _own[app]).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds the sums over all rows up to and including each, in an order in which no two rows are equal. Rows are range-sorted and
    settled; each range adds up its own and starts from the totals of those before it, one row for each range."""
    ranges = settled(rows.withColumns({f"_{k}": x for k, x in sums.items()}).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "running")
    totals = ranges.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_from_{k}") for k in sums])
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranges.select("*", *[F.sum(f"_{k}").over(upto).alias(f"_to_{k}") for k in sums])
    return within.join(F.broadcast(starts), "_range").select(*rows.columns, *[(F.col(f"_from_{k}") + F.col(f"_to_{k}")).alias(k) for k in sums])
