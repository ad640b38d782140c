"""From recognised regions and extracted values to judged fields, for all documents at once.

raw: (doc_id, fields map<string, string>) as a model answered; regions: as in ``layout``; routes: (doc_id, route), recognised
routes get their split numbers joined first. One shuffle key, doc_id, brings what is known of a document into one row, which carries the whole plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest
from . import binding, gate, identities, ingest, layout

# The stages of each route, in order.
STAGES = {
    "text": ("route", "geometry", "extract", "bind", "arithmetic", "gate"),
    "image": ("route", "recognise", "extract", "bind", "arithmetic", "gate"),
    "pdf-needs-render": ("route", "render", "recognise", "extract", "bind", "arithmetic", "gate"),
}
AMOUNTS = ("subtotal", "tax", "total")


def _amount(key: str) -> Column:
    """The largest wide amount of this key among a page's values that are bound to it."""
    trusted = F.filter("values", lambda v: (v["key"] == key) & (v["status"] != "unbound"))
    return F.array_max(F.transform(trusted, lambda v: v["value"].try_cast("bigint")))


def judged_pages(pages: DataFrame, template: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """pages: a row for each document, (doc_id, fields map<string, string> as a model answered, route, regions as ``layout.ON_PAGE``, lines: the sum of line items, if read).

    The same as ``judged_fields``, without a shuffle.
    """
    c = F.col
    read = pages.select("doc_id", "lines", F.when(c("route") == "text", c("regions")).alias("_text"), layout.joined_on_page(F.when(c("route") != "text", c("regions"))).alias("_joined"), ingest.coerced_values(c("fields"), template).alias("values"))
    known = read.select("doc_id", "lines", F.coalesce(c("_text").cast(layout.ON_PAGE), c("_joined")).alias("regions"), "values")
    bound = binding.bound_pages(known, labels).select("doc_id", "lines", "values")
    asked = {r["key"] for r in template.select("key").collect()}  # an amount that no template asks for is null, which the optimizer sees
    wide = identities.checked(bound.withColumns({k: _amount(k) if k in asked else F.lit(None).cast("bigint") for k in (*AMOUNTS, "tax_rate")}))
    rows = binding.each(wide.withColumn("_checks", identities.field_checks()), "_checks").withColumnRenamed("reason", "unbound_reason")
    check = F.get(F.filter("_checks", lambda x: (x["field"] == c("key")) & (x["n"] > 0)), F.lit(0))
    out = gate.judged(rows.withColumn("_check", check).withColumns({"arithmetic_ok": c("_check.ok"), "identity": c("_check.identity")}))
    why = gate.reason(c("verdict.check"), c("status"), c("type"), c("confidence"), c("unbound_reason"), c("identity"))
    return out.select("doc_id", "key", "type", "value", "status", "bbox", "text", "confidence", "source", "contested", "verdict", why.alias("reason"))


def judged_fields(raw: DataFrame, regions: DataFrame, routes: DataFrame, template: DataFrame, labels: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, type, value, status, bbox, text, confidence, source, contested, verdict, reason).

    Values that could not be coerced are left out, as neither admitted nor refused; they are the rejected rows of ``coerced_fields``.
    lines: (doc_id, lines) sums of line items, if read. Recognised pages get their split numbers joined; a text layer's regions stay as they are,
    and those of a document without a route are not read.
    """
    by = lambda rows: rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    pages = by(raw).select("doc_id", "fields").join(by(routes).select("doc_id", "route").hint("merge"), "doc_id", "left").join(binding.regions_of(regions).hint("merge"), "doc_id", "left")
    pages = pages.withColumn("lines", F.lit(None).cast("decimal(38,0)")) if lines is None else pages.join(by(lines).select("doc_id", "lines").hint("merge"), "doc_id", "left")
    return judged_pages(pages, template, labels)


def _body(stage: Column, reads: Column, writes: Column, content: Column) -> Column:
    """Canonical text of a trace record; stages and keys are plain ASCII identifiers."""
    quoted = F.concat(F.lit('["'), F.array_join(reads, '","'), F.lit('"]'))
    listed = F.when(F.size(reads) == 0, F.lit("[]")).otherwise(quoted)
    parts = (F.lit('{"action":"'), stage, F.lit('","digest":"'), digest(content), F.lit('","reads":'), listed, F.lit(',"stage":"'), stage, F.lit('","writes":"'), writes, F.lit('"}'))
    return F.concat(*parts)


def trace_records(fields: DataFrame, routes: DataFrame) -> DataFrame:
    """(run_id, pos, body) of every stage that a document's route goes through, over keys and digests, never values."""
    one = F.concat_ws("|", "key", F.coalesce("value", F.lit("")), "status", F.coalesce("verdict.check", F.lit("admitted")))
    of = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("rows"), F.array_sort(F.collect_list("key")).alias("keys"))
    known = routes.select(F.col("doc_id").cast("string").alias("doc_id"), "route").join(of, "doc_id")
    stages = F.lit(None).cast("array<string>")
    for route, names in STAGES.items():
        stages = F.when(F.col("route") == route, F.array(*map(F.lit, names))).otherwise(stages)
    rows = known.select("doc_id", "rows", "keys", F.posexplode(stages).alias("pos", "stage"))
    body = _body(F.col("stage"), F.col("keys"), F.col("stage"), F.concat(F.col("stage"), F.array_join("rows", "\n")))
    return rows.select(F.col("doc_id").alias("run_id"), "pos", body.alias("body"))
