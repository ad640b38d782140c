"""The star-schema tables read as the domain's tables, for queries with an oracle.

Vendors are customers, ledger records are orders, documents are orders again, changed by order number modulo 8: exact, two
cents under, one unit under, ten times the amount, another currency, as ordered from whatever vendor, of no record, total withheld.
Orders of numbers 0 and 1 modulo 40 share a reference, and exact documents of numbers 0 modulo 16 carry none.
``CTES`` says the same in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..functions.numbers import minor_of

CURRENCIES = ("EUR", "USD", "GBP", "ARS")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: Column | str) -> DataFrame:
    """The same rows dealt by a key to all tasks: a table may lie in one file of few row groups, and the work on a row costs far more than moving its few columns."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def currency(key):
    return F.element_at(F.array(*map(F.lit, CURRENCIES)), (F.pmod(key, F.lit(4)) + 1).cast("int"))


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("vendor_id"), F.col("c_name").alias("vendor_name"), (F.col("c_acctbal") >= 0).alias("active"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    shared = F.when(k % 40 == 1, k - 1).otherwise(k)
    return o.select(
        k.alias("record_id"), F.col("o_custkey").alias("vendor_id"), F.concat(F.lit("PO-"), shared.cast("string")).alias("reference"), currency(F.col("o_custkey")).alias("currency"),
        minor_of(F.col("o_totalprice")).alias("amount_minor"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, reference, vendor, currency, total, seen, currency_state, currency_by, total_state, total_by)"""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    d = o.join(c, "o_custkey")
    k, kind = F.col("o_orderkey"), F.col("o_orderkey") % 8
    amount = minor_of(F.col("o_totalprice"))
    none = F.lit(None).cast("string")
    return d.select(
        k.alias("doc_id"),
        kind.cast("int").alias("kind"),
        F.when(kind == 6, F.concat(F.lit("XX "), k.cast("string"))).when(k % 16 == 0, none).otherwise(F.concat(F.lit("po "), k.cast("string"))).alias("reference"),
        F.when(kind == 6, "Nobody").otherwise(F.col("c_name")).alias("vendor"),
        F.when(kind == 4, "NOK").otherwise(currency(F.col("o_custkey"))).alias("currency"),
        F.when(kind == 1, amount - 2).when(kind == 2, amount - 100).when(kind == 3, amount * 10).otherwise(amount).alias("amount_minor"),
        (k % 97 == 5).alias("seen"),
        F.when(k % 53 == 7, "withheld").when(k % 59 == 3, "missing").otherwise("have").alias("currency_state"),
        F.when(k % 53 == 7, "confidence").alias("currency_by"),
        F.when(kind == 7, "withheld").otherwise("have").alias("total_state"),
        F.when(kind == 7, "arithmetic").alias("total_by"),
    ).withColumn("total", F.col("amount_minor"))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' amounts from their line items: (doc_id, subtotal, tax, total, tax_rate, lines), some made to disagree or to lack a part."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), minor_of(F.col("l_extendedprice")).alias("minor"))
    s = line.groupBy("doc_id").agg(F.sum(F.col("minor").cast("decimal(38,0)")).alias("lines"))
    subtotal = F.col("lines").cast("bigint")
    rate = (F.col("doc_id") % 25).cast("bigint")
    tax = (subtotal * rate - subtotal * rate % 100) / 100
    s = s.withColumn("subtotal", subtotal + F.when(F.col("doc_id") % 11 == 0, 5).otherwise(0)).withColumn("tax_rate", rate).withColumn("tax", tax.cast("bigint"))
    s = s.withColumn("total", F.when(F.col("doc_id") % 13 == 0, None).otherwise(F.col("subtotal") + F.col("tax") + F.when(F.col("doc_id") % 7 == 0, 3).otherwise(0)))
    return s.withColumn("tax_rate", F.when(F.col("doc_id") % 17 == 0, None).otherwise(F.col("tax_rate"))).select("doc_id", "subtotal", "tax", "total", "tax_rate", "lines")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fields to judge: (doc_id, key, type, value, status, source, confidence, arithmetic_ok)."""
    x = table(spark, sf_dir, "lineitem")
    k, part = F.col("l_orderkey") + F.col("l_linenumber"), F.col("l_partkey").cast("string")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    return x.select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("key"),
        pick(("string", "amount", "date", "integer"), k).alias("type"),
        F.when(k % 19 != 0, F.when(k % 4 == 0, F.concat(F.lit("Part "), part)).when(k % 4 == 2, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("l_partkey") % 1000).cast("int")).cast("string")).otherwise(part)).alias("value"),
        pick(("region", "span", "region", "unbound", "region"), F.col("l_partkey")).alias("status"),
        F.when(F.col("l_suppkey") % 6 == 0, "text-layer").alias("source"),
        F.when(F.col("l_partkey") % 23 != 0, F.col("l_quantity") / 50).alias("confidence"),
        F.when(F.col("l_returnflag") == "R", False).when(F.col("l_returnflag") == "A", True).alias("arithmetic_ok"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes for each line item: (doc_id, line, part, a, b)."""
    x = table(spark, sf_dir, "lineitem")
    q, n, d = F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_discount")
    return x.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        box(n * 10, q, n * 10 + q, q + 20).alias("a"), box(n * 10 + d * 100, q + n, n * 10 + d * 100 + q - 5, q + n + 12).alias("b"),
    )


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the digest of their text: (digest, path, route, read_at)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.sha2("text", 256).alias("digest"), F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.col("source").alias("route"), F.col("doc_id").alias("read_at"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of the plan, interrupted at some step: (run_id, seq, key, type, value, provenance)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", minor_of(F.col("o_totalprice")).alias("minor"))
    k = F.col("o_orderkey")
    row = lambda seq, key, kind, value, source: F.struct(F.lit(seq).alias("seq"), F.lit(key).alias("key"), F.lit(kind).alias("type"), value.alias("value"), F.lit(source).alias("provenance"))
    all_ = F.array(
        row(0, "doc.reference", "string", F.concat(F.lit("PO-"), k.cast("string")), "document-asserted"),
        row(1, "doc.total", "amount", (F.col("minor") + k % 5 - 2).cast("string"), "document-asserted"),
        row(2, "record.amount", "amount", F.col("minor").cast("string"), "source-attested"),
        row(3, "variance", "amount", F.lit("0"), "host-computed"),
    )
    return o.select(k.alias("run_id"), F.explode(F.slice(all_, 1, (k % 4 + 1).cast("int"))).alias("s")).select("run_id", "s.*")


_CUR = "(['EUR', 'USD', 'GBP', 'ARS'])[(o_custkey % 4 + 1)::INT]"
CTES = f"""
vendors AS (SELECT c_custkey AS vendor_id, c_name AS vendor_name, c_acctbal >= 0 AS active FROM customer),
records AS (SELECT o_orderkey AS record_id, o_custkey AS vendor_id, 'PO-' || (CASE WHEN o_orderkey % 40 = 1 THEN o_orderkey - 1 ELSE o_orderkey END) AS reference,
  {_CUR} AS currency, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor FROM orders),
ledger AS (SELECT record_id, reference, regexp_replace(lower(reference), '[^a-z0-9]+', '', 'g') AS reference_key, vendor_name, active, currency, amount_minor FROM records JOIN vendors USING (vendor_id)),
docs AS (SELECT o_orderkey AS doc_id, o_orderkey % 8 AS kind,
  CASE WHEN o_orderkey % 8 = 6 THEN 'XX ' || o_orderkey WHEN o_orderkey % 16 = 0 THEN NULL ELSE 'po ' || o_orderkey END AS reference,
  CASE WHEN o_orderkey % 8 = 6 THEN 'Nobody' ELSE c_name END AS vendor,
  CASE WHEN o_orderkey % 8 = 4 THEN 'NOK' ELSE {_CUR} END AS currency,
  CAST(round(o_totalprice * 100) AS BIGINT) * (CASE WHEN o_orderkey % 8 = 3 THEN 10 ELSE 1 END) - (CASE o_orderkey % 8 WHEN 1 THEN 2 WHEN 2 THEN 100 ELSE 0 END) AS amount_minor,
  o_orderkey % 97 = 5 AS seen,
  CASE WHEN o_orderkey % 53 = 7 THEN 'withheld' WHEN o_orderkey % 59 = 3 THEN 'missing' ELSE 'have' END AS currency_state,
  CASE WHEN o_orderkey % 8 = 7 THEN 'withheld' ELSE 'have' END AS total_state
  FROM orders JOIN customer ON c_custkey = o_custkey),
tier1 AS (SELECT d.doc_id, l.* FROM docs d JOIN ledger l ON l.reference_key = regexp_replace(lower(d.reference), '[^a-z0-9]+', '', 'g') WHERE d.reference <> ''),
tier2 AS (SELECT d.doc_id, l.* FROM docs d JOIN ledger l ON l.vendor_name = d.vendor AND l.currency = d.currency AND l.amount_minor = d.amount_minor WHERE d.doc_id NOT IN (SELECT doc_id FROM tier1)),
found AS (SELECT *, 1 AS tier FROM tier1 UNION ALL SELECT *, 2 AS tier FROM tier2),
best AS (SELECT doc_id, count(*) AS matches, min(record_id) AS record_id FROM found GROUP BY doc_id),
checked AS (
  SELECT d.doc_id, d.kind, b.record_id, b.record_id IS NOT NULL AS has_record, d.seen, b.matches, f.active,
    d.currency_state, coalesce(d.currency_state = 'have' AND lower(d.currency) = lower(f.currency), FALSE) AS same, d.total_state, d.amount_minor - f.amount_minor AS diff
  FROM docs d LEFT JOIN best b USING (doc_id) LEFT JOIN found f ON f.doc_id = d.doc_id AND f.record_id = b.record_id),
outcomes AS (
  SELECT *, CASE WHEN seen THEN 'fail' ELSE 'pass' END AS c1, CASE WHEN matches > 1 THEN 'indeterminate' ELSE 'pass' END AS c2, CASE WHEN active THEN 'pass' ELSE 'fail' END AS c3,
    CASE WHEN currency_state <> 'have' THEN 'indeterminate' WHEN same THEN 'pass' ELSE 'fail' END AS c4,
    CASE WHEN NOT same OR total_state <> 'have' THEN 'indeterminate' WHEN abs(diff) <= 2 THEN 'pass' ELSE 'fail' END AS c5 FROM checked),
verdicts AS (
  SELECT doc_id, kind, record_id, CASE WHEN same AND total_state = 'have' THEN diff END AS variance_minor,
    CASE WHEN NOT has_record THEN 'no-candidate' WHEN 'fail' IN (c1, c2, c3, c4, c5) THEN 'mismatch' WHEN 'indeterminate' IN (c1, c2, c3, c4, c5) THEN 'indeterminate' ELSE 'matched' END AS decision
  FROM outcomes),
lines AS (SELECT l_orderkey AS doc_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS lines FROM lineitem GROUP BY l_orderkey),
amounts AS (
  SELECT doc_id, lines + (CASE WHEN doc_id % 11 = 0 THEN 5 ELSE 0 END) AS subtotal, lines * (doc_id % 25) // 100 AS tax,
    CASE WHEN doc_id % 13 <> 0 THEN lines + (CASE WHEN doc_id % 11 = 0 THEN 5 ELSE 0 END) + lines * (doc_id % 25) // 100 + (CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END) END AS total,
    CASE WHEN doc_id % 17 <> 0 THEN doc_id % 25 END AS tax_rate, lines FROM lines),
differences AS (SELECT *, lines - subtotal AS d1, subtotal + tax - total AS d2, tax - subtotal * tax_rate * 100 // 10000 AS d3 FROM amounts),
fields AS (
  SELECT l_orderkey AS doc_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key, (['string', 'amount', 'date', 'integer'])[((l_orderkey + l_linenumber) % 4 + 1)::INT] AS type,
    CASE WHEN (l_orderkey + l_linenumber) % 19 <> 0 THEN CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'Part ' || l_partkey WHEN 2 THEN strftime(DATE '2020-01-01' + (l_partkey % 1000)::INTEGER, '%Y-%m-%d') ELSE l_partkey::VARCHAR END END AS value, (['region', 'span', 'region', 'unbound', 'region'])[(l_partkey % 5 + 1)::INT] AS status,
    CASE WHEN l_suppkey % 6 = 0 THEN 'text-layer' END AS source, CASE WHEN l_partkey % 23 <> 0 THEN l_quantity / 50 END AS confidence,
    CASE l_returnflag WHEN 'R' THEN FALSE WHEN 'A' THEN TRUE END AS arithmetic_ok, l_partkey FROM lineitem),
judged AS (
  SELECT *, CASE WHEN value IS NULL THEN 'absent' WHEN status = 'unbound' THEN 'binding'
    WHEN source IS NULL AND coalesce(confidence < (CASE type WHEN 'string' THEN 0.35::DOUBLE WHEN 'date' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END) + (CASE WHEN status = 'span' THEN 0.15::DOUBLE ELSE 0 END), TRUE) THEN 'confidence'
    WHEN arithmetic_ok = FALSE THEN 'arithmetic' END AS chk FROM fields),
slots AS (SELECT o_orderkey AS run_id, s.seq, s.key, s.type, s.provenance, CAST(round(o_totalprice * 100) AS BIGINT) + o_orderkey % 5 - 2 AS minor FROM orders, (VALUES (0, 'doc.reference', 'string', 'document-asserted'), (1, 'doc.total', 'amount', 'document-asserted'),
  (2, 'record.amount', 'amount', 'source-attested'), (3, 'variance', 'amount', 'host-computed')) s(seq, key, type, provenance) WHERE s.seq <= o_orderkey % 4)
"""


def sql(body: str) -> str:
    return f"WITH {CTES.strip()}\n{body}"
