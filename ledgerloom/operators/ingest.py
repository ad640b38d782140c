"""Ledger files: the validation chain over parsed rows, duplicates, and loading into the ledger."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import coerce_date
from ..functions.money import parse_amount
from ..functions.numbers import once
from ..functions.text import reference_key, trimmed
from ..functions.values import coerced

# Header patterns of each field, fields in order.
HEADERS = (
    ("reference", (r"^ref", r"^po\b", r"number", r"orden")),
    ("vendor", (r"^vendor", r"^supplier", r"^proveedor", r"^name")),
    ("amount", (r"amount", r"total", r"^net", r"importe")),
    ("currency", (r"^currency", r"^ccy", r"^moneda")),
    ("issued_on", (r"date", r"issued", r"fecha")),
)
FIELDS = tuple(f for f, _ in HEADERS)


def proposed_mapping(header: list[str]) -> dict[str, int | None]:
    """Column of each field, to be confirmed by a person: the first free cell that one of its patterns fits."""
    taken: set[int] = set()
    out: dict[str, int | None] = {}
    for field, patterns in HEADERS:
        fits = (i for i, cell in enumerate(header) if i not in taken and any(re.search(p, cell.strip(), re.I) for p in patterns))
        out[field] = next(fits, None)
        taken |= {out[field]} - {None}
    return out


def _quoted(s: Column) -> Column:
    return F.coalesce(F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2), F.lit("null"))


def validated(rows: DataFrame) -> DataFrame:
    """rows: (file, line, cells, width, reference, vendor, amount, currency, issued_on): mapped texts, null where a field has no column.

    Adds reason (null for good rows), amount_minor, iso currency and date. The first rule broken is the reason; among
    rows that pass all, later ones of the same vendor and reference are duplicates of the first line.
    """
    t = {f: trimmed(F.col(f)) for f in FIELDS}
    rows = rows.withColumn("_p", parse_amount(t["amount"])).withColumn("_d", coerce_date(t["issued_on"]))
    currency = F.coalesce(F.nullif(t["currency"], F.lit("")), F.col("_p.currency"))
    empty = lambda f: F.coalesce(t[f], F.lit("")) == ""
    size = F.size("cells")
    reason = (
        F.when(size != F.col("width"), F.concat(F.lit("row has "), size.cast("string"), F.lit(" cells and the header has "), F.col("width").cast("string")))
        .when(empty("reference"), "no reference")
        .when(empty("vendor"), "no vendor")
        .when(F.col("_p").isNull(), F.concat(F.lit("amount is not a number: "), _quoted(t["amount"])))
        .when(currency.isNull(), "no currency in the row and none in the amount")
        .when(~empty("issued_on") & F.col("_d").isNull(), F.concat(F.lit("date is not readable: "), _quoted(t["issued_on"])))
    )
    rows = rows.withColumn("reason", reason)
    same = Window.partitionBy("file", F.col("reason").isNull(), F.when(F.col("reason").isNull(), F.concat_ws(" ", t["vendor"], t["reference"])).otherwise(F.xxhash64("line").cast("string")))
    rows = rows.withColumn("_first", F.min("line").over(same))
    again = F.col("reason").isNull() & (F.col("line") > F.col("_first"))
    rows = rows.withColumn("reason", F.when(again, F.concat(F.lit("duplicate reference, first seen at line "), F.col("_first").cast("string"))).otherwise(F.col("reason")))
    return rows.select(
        "file", "line", "reason", t["reference"].alias("reference"), t["vendor"].alias("vendor"), F.upper(currency).alias("currency"), F.col("_p.minor").alias("amount_minor"), F.col("_d").alias("issued_on"), "cells"
    )


def mapped(grid: DataFrame, mapping: dict[str, int | None]) -> DataFrame:
    """grid: (file, line, cells) with the header at line 1. Rows below it with their fields by the confirmed mapping."""
    width = grid.filter("line = 1").select("file", F.size("cells").alias("width"))
    cell = lambda i: F.lit(None).cast("string") if i is None else F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    rows = grid.filter("line > 1").join(width, "file")
    return rows.select("file", "line", "cells", "width", *[cell(mapping[f]).alias(f) for f in FIELDS])


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter("reason is null").select("file", "line", "reference", "vendor", "currency", "amount_minor", "issued_on")


def rejected(checked: DataFrame, delimiter: str = ",") -> DataFrame:
    return checked.filter("reason is not null").select("file", "line", "reason", F.array_join("cells", delimiter).alias("raw"))


def with_ids(new: DataFrame, order: list[str], known: DataFrame, id_column: str) -> DataFrame:
    """Consecutive ids after the largest known one.

    Rows are ranked within hashed parts of ``order`` and parts by the counts before them, so no task sees all rows.
    """
    parts = 1024
    part = F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    rows = new.withColumn("_part", part)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 1024 rows at most
    last = known.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_last"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    base = F.broadcast(counts.select("_part", start.alias("_start")))
    last_id = last.collect()[0][0]
    return rows.withColumn("_w", within).join(base, "_part").withColumn(id_column, (F.col("_w") + F.col("_start") + last_id).cast("bigint")).drop("_part", "_w", "_start")


def vendors_to_add(rows: DataFrame, vendors: DataFrame) -> DataFrame:
    """Names of the batch that the ledger does not know: (vendor_id, vendor_name, active)."""
    names = rows.select(F.col("vendor").alias("vendor_name")).distinct().join(vendors, "vendor_name", "left_anti")
    return with_ids(names, ["vendor_name"], vendors, "vendor_id").select("vendor_id", "vendor_name", F.lit(True).alias("active"))


def loaded(rows: DataFrame, vendors: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new vendors, new records, skipped): rows whose vendor and reference the ledger or an earlier row has are skipped.

    rows: (line, reference, vendor, currency, amount_minor, issued_on).
    """
    new_vendors = vendors_to_add(rows, vendors)
    known = vendors.groupBy("vendor_name").agg(F.min("vendor_id").alias("vendor_id")).unionByName(new_vendors.select("vendor_name", "vendor_id"))
    keyed = rows.join(known, rows["vendor"] == known["vendor_name"]).drop("vendor_name")
    nth = F.row_number().over(Window.partitionBy("vendor_id", "reference").orderBy("line"))
    keyed = keyed.withColumn("_nth", nth)
    there = records.select("vendor_id", "reference").distinct().withColumn("_there", F.lit(True))
    keyed = keyed.join(there, ["vendor_id", "reference"], "left")
    out = F.col("_there").isNotNull() | (F.col("_nth") > 1)
    skipped = keyed.filter(out).select("line", "vendor", "reference", F.lit("already in the ledger").alias("reason"))
    fresh = keyed.filter(~out).drop("_nth", "_there")
    fresh = with_ids(fresh, ["vendor_id", "reference"], records, "record_id").withColumn("reference_key", reference_key(F.col("reference")))
    return new_vendors, fresh.select("record_id", "vendor_id", "reference", "reference_key", "currency", "amount_minor", "issued_on"), skipped


def deactivated(vendors: DataFrame, names: DataFrame) -> DataFrame:
    """Every vendor of one of the names made inactive. names: (vendor_name)."""
    hit = names.select("vendor_name").distinct().withColumn("_off", F.lit(True))
    return vendors.join(hit, "vendor_name", "left").withColumn("active", F.col("active") & F.col("_off").isNull()).drop("_off")


def coerced_fields(raw: DataFrame, template: DataFrame) -> DataFrame:
    """raw: (doc_id, fields map<string, string>); template: (pos, key, type), of a user's size.

    (doc_id, key, type, raw, value, status, reason): status ok, absent or rejected; undeclared keys are rejected, too.
    """
    article = F.create_map(*[F.lit(x) for pair in (("string", "a string"), ("amount", "an amount"), ("date", "a date"), ("integer", "an integer")) for x in pair])
    declared = raw.select("doc_id", "fields", F.explode(_constant(template)).alias("t")).select("doc_id", "fields", "t.*")
    # in steps, as each expression is read several times and would be computed as often
    read = declared.select("doc_id", "key", "type", F.try_element_at("fields", F.col("key")).alias("raw"))
    read = read.withColumn("_blank", F.coalesce(trimmed(F.col("raw")), F.lit("")) == "").withColumn("value", F.when(~F.col("_blank"), coerced(F.col("type"), F.col("raw"))))
    read = read.withColumn("status", F.when(F.col("_blank"), "absent").when(F.col("value").isNull(), "rejected").otherwise("ok"))
    known = read.select(
        "doc_id", "key", "type", "raw", "value", "status",
        F.when(F.col("status") == "rejected", F.concat(F.lit("not "), article[F.col("type")], F.lit(": "), _quoted(F.col("raw")))).alias("reason"),
    )
    keys = F.transform(_constant(template), lambda t: t["key"])
    other = raw.select("doc_id", F.explode_outer(F.array_except(F.map_keys("fields"), keys)).alias("key"), "fields").filter("key is not null")
    other = other.select(
        "doc_id", "key", F.lit(None).cast("string").alias("type"), F.try_element_at("fields", F.col("key")).alias("raw"), F.lit(None).cast("string").alias("value"), F.lit("rejected").alias("status"),
        F.concat(F.lit('"'), F.col("key"), F.lit('" is not in the template')).alias("reason"),
    )
    return known.unionByName(other)


def coerced_values(fields: Column, template: DataFrame) -> Column:
    """The declared fields of a map<string, string> that are absent (value null) or could be coerced, as an array of (key, type, value)."""

    def read(t: Column) -> Column:
        raw = F.try_element_at(fields, t["key"])
        value = lambda x: F.when(F.coalesce(trimmed(x), F.lit("")) == "", F.struct(F.lit(False).alias("bad"), F.lit(None).cast("string").alias("value"))).otherwise(once(coerced(t["type"], x), lambda v: F.struct(v.isNull().alias("bad"), v.alias("value"))))
        return once(once(raw, value), lambda v: F.struct(t["key"].alias("key"), t["type"].alias("type"), v["value"].alias("value"), v["bad"].alias("bad")))

    good = F.filter(F.transform(_constant(template), read), lambda v: ~v["bad"])
    return F.transform(good, lambda v: F.struct(v["key"].alias("key"), v["type"].alias("type"), v["value"].alias("value")))


def _constant(template: DataFrame) -> Column:
    rows = sorted(template.select("pos", "key", "type").collect())
    return F.array(*[F.struct(F.lit(r["key"]).alias("key"), F.lit(r["type"]).alias("type")) for r in rows])


# The JSON types of the field types.
JSON_TYPES = {"string": "string", "amount": "string", "date": "string", "integer": "integer"}


def answer_schema(template: list[tuple[int, str, str]]) -> dict:
    """The JSON schema a model must answer in: every field of the template, required and nullable, and no other."""
    unknown = {kind for _, _, kind in template} - set(JSON_TYPES)
    if unknown:
        raise ValueError(f"unknown field types: {sorted(unknown)}")
    fields = sorted(template)
    return {"type": "object", "properties": {key: {"type": [JSON_TYPES[kind], "null"]} for _, key, kind in fields}, "required": [key for _, key, _ in fields], "additionalProperties": False}


def instruction(template: list[tuple[int, str, str, str]]) -> str:
    """What to ask a model for: a line for each field."""
    return "\n".join(f"{key}: {label} ({kind})" for _, key, kind, label in sorted(template))
