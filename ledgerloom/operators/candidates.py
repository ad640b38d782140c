"""Which ledger records a document may stand for.

ledger: (record_id, reference, reference_key, vendor_name, active, currency, amount_minor).
docs: (doc_id, reference, vendor, currency, amount_minor), the values as read, admitted or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import reference_key

RECORD = ["record_id", "reference", "vendor_name", "active", "currency", "amount_minor"]


def ledger_of(records: DataFrame, vendors: DataFrame) -> DataFrame:
    """records: (record_id, vendor_id, reference, currency, amount_minor); vendors: (vendor_id, vendor_name, active)."""
    r = records.withColumn("reference_key", reference_key(F.col("reference")))
    return r.join(vendors, "vendor_id").select("record_id", "reference", "reference_key", "vendor_name", "active", "currency", "amount_minor")


def by_reference(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    d = docs.filter(F.coalesce("reference", F.lit("")) != "").select("doc_id", reference_key(F.col("reference")).alias("reference_key"))
    return d.join(ledger, "reference_key").select("doc_id", *RECORD)


def by_vendor_amount(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Exact vendor name, currency and amount together; a null or empty one matches nothing."""
    d = docs.filter((F.coalesce("vendor", F.lit("")) != "") & (F.coalesce("currency", F.lit("")) != "")).select("doc_id", F.col("vendor").alias("vendor_name"), "currency", "amount_minor")
    return d.join(ledger, ["vendor_name", "currency", "amount_minor"]).select("doc_id", *RECORD)


def tiered(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """By reference; documents without a hit there by vendor, currency and amount. Adds ``tier``."""
    first = by_reference(docs, ledger)
    rest = docs.join(first.select("doc_id").distinct(), "doc_id", "left_anti")
    return first.withColumn("tier", F.lit(1)).unionByName(by_vendor_amount(rest, ledger).withColumn("tier", F.lit(2)))


def _per_key(ledger: DataFrame, keys: list[str], listed: int | None) -> DataFrame:
    """For each key the record of lowest id, how many records there are, and their references by id, all or the first ``listed``."""
    of = F.struct("record_id", *[c for c in RECORD if c != "record_id"])
    rows = ledger
    if listed is not None:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("record_id"))
        rows = ledger.withColumn("_nth", nth).filter(F.col("_nth") <= listed)
    names = F.array_sort(F.collect_list(F.struct("record_id", "reference")))
    first = rows.groupBy(*keys).agg(F.min(of).alias("record"), names.alias("l"), F.count(F.lit(1)).alias("matches"))
    first = first.select(*keys, "record", F.array_join(F.transform("l", lambda x: x["reference"]), ", ").alias("references"), "matches")
    if listed is None:
        return first
    return first.drop("matches").join(ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches")), keys)


def chosen(docs: DataFrame, ledger: DataFrame, listed: int | None = None) -> DataFrame:
    """(doc_id, tier, matches, record, references): for each document with a candidate the record of lowest id, how many match, and their references.

    The ledger is summed up for each key before documents meet it, so a reference that many documents and records share
    gives one row for each document. ``listed`` bounds how many references are spelled out; by default all are.
    """
    found = ["matches", "record", "references"]
    keyed = docs.withColumn("_key", F.when(F.coalesce("reference", F.lit("")) != "", reference_key(F.col("reference"))))
    by_key = _per_key(ledger.withColumnRenamed("reference_key", "_key"), ["_key"], listed)
    first = keyed.select("doc_id", "vendor", "currency", "amount_minor", "_key").join(by_key, "_key", "left")
    triple = ["vendor_name", "currency", "amount_minor"]
    by_triple = _per_key(ledger, triple, listed)
    known = (F.coalesce("vendor", F.lit("")) != "") & (F.coalesce("currency", F.lit("")) != "")
    rest = first.filter(F.col("record").isNull() & known).select("doc_id", F.col("vendor").alias("vendor_name"), "currency", "amount_minor")
    second = rest.join(by_triple, triple).select("doc_id", F.lit(2).alias("tier"), *found)
    return first.filter("record is not null").select("doc_id", F.lit(1).alias("tier"), *found).unionByName(second)
