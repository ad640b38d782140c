"""Named queries over the star-schema tables, each with the same question in DuckDB SQL.

Every query calls operators of this package on whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import file_queries, page_queries, run_queries  # noqa: F401  (register their queries, too)
from .functions import dates, geometry, money, numbers, text
from .operators import candidates, certificates, documents, gate, identities, ingest, planner, reconcile, scoring, trace
from .plans import mapped
from .plans.mapped import sql, table
from .registry import ORACLE, QUERIES, named  # noqa: F401
from .streaming.logs import by_window

c = F.col


# Money, dates, text keys


def _printed(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numbers.minor_of(c("l_extendedprice")).alias("minor"))
    k = c("l_orderkey") % 4
    shown = (
        F.when(k == 0, money.anglo(c("minor"))).when(k == 1, F.concat(F.lit("EUR "), money.latin(c("minor")))).when(k == 2, F.concat(F.lit("$"), money.anglo(c("minor")))).otherwise(F.concat(money.latin(c("minor")), F.lit(" €")))
    )
    return x.withColumn("printed", shown)


@named(
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS minor,
  CASE l_orderkey % 4 WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' END AS currency,
  CASE WHEN l_orderkey % 4 IN (0, 2) THEN 'anglo' ELSE 'latin' END AS convention FROM lineitem"""
)
def parse_amount_roundtrip(spark, d):
    p = _printed(spark, d).withColumn("p", money.parse_amount(c("printed")))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", c("p.minor").cast("bigint").alias("minor"), "p.currency", "p.convention")


@named(
    """SELECT o_orderkey, CASE WHEN m < 0 THEN '-' ELSE '' END || (abs(m) // 100) || '.' || lpad((abs(m) % 100)::VARCHAR, 2, '0') AS shown
FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) AS m FROM orders)"""
)
def format_minor(spark, d):
    m = numbers.minor_of(c("o_totalprice")) * F.when(c("o_orderkey") % 3 == 0, -1).otherwise(1)
    return table(spark, d, "orders").select("o_orderkey", money.format_minor(m).alias("shown"))


@named("""SELECT p_partkey, regexp_replace(lower(p_name || '/' || p_brand || ' ' || p_partkey), '[^a-z0-9]+', '', 'g') AS reference_key,
  trim(regexp_replace(lower(p_type || ' - ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS loose, regexp_replace(upper(p_type), '[^A-Z0-9]+', '', 'g') AS upper_key FROM part""")
def reference_key_norm(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        text.reference_key(F.concat("p_name", F.lit("/"), "p_brand", F.lit(" "), c("p_partkey").cast("string"))).alias("reference_key"),
        text.loose(F.concat("p_type", F.lit(" - "), "p_brand")).alias("loose"),
        text.upper_alnum(c("p_type")).alias("upper_key"),
    )


@named("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""")
def coerce_date(spark, d):
    k, at = c("o_orderkey") % 4, c("o_orderdate")
    shown = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "d MMMM yyyy")).when(k == 2, F.date_format(at, "dd/MM/yyyy")).otherwise(F.date_format(at, "yyyy-'13'-dd"))
    return table(spark, d, "orders").select("o_orderkey", dates.coerce_date(shown).alias("iso"))


# Ledger ingestion


def _import_rows(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(c("c_custkey").alias("o_custkey"), "c_name").hint("merge"), "o_custkey")  # customers grow, too
    k = c("o_orderkey")
    number = F.when(k % 20 == 3, k - k % 100).otherwise(k)
    rows = o.select(
        F.lit("orders").alias("file"), (k + 1).alias("line"),
        F.when(k % 31 == 0, " ").otherwise(F.concat(F.lit("PO-"), number.cast("string"))).alias("reference"),
        F.when(k % 37 == 0, "").when(k % 20 == 3, "One vendor").otherwise(c("c_name")).alias("vendor"),
        F.when(k % 41 == 0, "n/a").otherwise(money.latin(numbers.minor_of(c("o_totalprice")))).alias("amount"),
        F.when(k % 43 == 0, "").otherwise("eur").alias("currency"),
        F.when(k % 47 == 0, "14/03/2026").when(k % 3 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("issued_on"),
    )
    cells = F.array("reference", "vendor", "amount", "currency", "issued_on")
    return rows.withColumn("cells", F.when(c("line") % 29 == 0, F.array_append(cells, F.lit("x"))).otherwise(cells)).withColumn("width", F.lit(5))


_IMPORT = """WITH r AS (
  SELECT o_orderkey + 1 AS line, o_orderkey AS k, CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'PO-' || (CASE WHEN o_orderkey % 20 = 3 THEN o_orderkey - o_orderkey % 100 ELSE o_orderkey END) END AS reference,
    CASE WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderkey % 20 = 3 THEN 'One vendor' ELSE c_name END AS vendor, CAST(round(o_totalprice * 100) AS BIGINT) AS minor, o_orderdate
  FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT *, CASE WHEN line % 29 = 0 THEN 'row has 6 cells and the header has 5' WHEN reference = '' THEN 'no reference' WHEN vendor = '' THEN 'no vendor'
    WHEN k % 41 = 0 THEN 'amount is not a number: "n/a"' WHEN k % 43 = 0 THEN 'no currency in the row and none in the amount' WHEN k % 47 = 0 THEN 'date is not readable: "14/03/2026"' END AS why FROM r),
t AS (SELECT *, min(line) OVER (PARTITION BY why IS NULL, vendor || ' ' || reference) AS first_line FROM s),
u AS (SELECT line, reference, vendor, minor, CASE WHEN k % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS issued_on, CASE WHEN why IS NULL AND line > first_line THEN 'duplicate reference, first seen at line ' || first_line ELSE why END AS reason FROM t)
"""


@named(_IMPORT + "SELECT line, reason FROM u WHERE reason IS NOT NULL")
def import_validate(spark, d):
    return ingest.rejected(ingest.validated(_import_rows(spark, d))).select("line", "reason")


@named(_IMPORT + "SELECT line, reference, vendor, 'EUR' AS currency, minor AS amount_minor, issued_on FROM u WHERE reason IS NULL")
def import_accepted(spark, d):
    rows = ingest.accepted(ingest.validated(_import_rows(spark, d)))
    return rows.select("line", "reference", "vendor", "currency", c("amount_minor").cast("bigint").alias("amount_minor"), "issued_on")


@named(_IMPORT + "SELECT count(*) AS duplicates, count(DISTINCT reference) AS refs FROM u WHERE reason LIKE 'duplicate%'")
def import_duplicates(spark, d):
    bad = ingest.validated(_import_rows(spark, d)).filter(c("reason").startswith("duplicate"))
    return bad.agg(F.count(F.lit(1)).alias("duplicates"), F.countDistinct("reference").alias("refs"))


def _batch(spark, d):
    """Half of the ledger's rows again, and rows of vendors it does not know."""
    r = mapped.records(spark, d).join(mapped.vendors(spark, d), "vendor_id")
    vendor = F.when(c("record_id") % 5 == 0, F.concat(F.lit("New "), (c("record_id") % 50).cast("string"))).otherwise(c("vendor_name"))
    return r.select(c("record_id").alias("line"), "reference", vendor.alias("vendor"), "currency", "amount_minor", F.lit(None).cast("string").alias("issued_on"))


def _known(spark, d):
    return mapped.records(spark, d).filter("record_id % 2 = 0")


_LOAD = """, batch AS (SELECT record_id AS line, reference, CASE WHEN record_id % 5 = 0 THEN 'New ' || record_id % 50 ELSE vendor_name END AS vendor FROM records JOIN vendors USING (vendor_id)),
known AS (SELECT DISTINCT vendor_name, reference FROM records JOIN vendors USING (vendor_id) WHERE record_id % 2 = 0),
nth AS (SELECT *, row_number() OVER (PARTITION BY vendor, reference ORDER BY line) AS n FROM batch),
skip AS (SELECT line, vendor, reference, n > 1 OR (vendor, reference) IN (SELECT (vendor_name, reference) FROM known) AS out FROM nth)
"""


@named(sql(_LOAD + "SELECT line, vendor, reference, 'already in the ledger' AS reason FROM skip WHERE out"))
def ledger_load_skips(spark, d):
    return ingest.loaded(_batch(spark, d), mapped.vendors(spark, d), _known(spark, d))[2]


@named(sql(_LOAD + "SELECT vendor, reference FROM skip WHERE NOT out"))
def ledger_load_records(spark, d):
    new_vendors, fresh, _ = ingest.loaded(_batch(spark, d), mapped.vendors(spark, d), _known(spark, d))
    names = mapped.vendors(spark, d).select("vendor_id", "vendor_name").unionByName(new_vendors.select("vendor_id", "vendor_name"))
    return fresh.join(names, "vendor_id").select(c("vendor_name").alias("vendor"), "reference")


@named(sql(_LOAD + "SELECT DISTINCT vendor AS vendor_name, TRUE AS active FROM batch WHERE vendor NOT IN (SELECT vendor_name FROM vendors)"))
def vendor_get_or_create(spark, d):
    return ingest.vendors_to_add(_batch(spark, d), mapped.vendors(spark, d)).select("vendor_name", "active")


@named(sql("SELECT vendor_id, vendor_name, active AND vendor_id % 7 <> 0 AS active FROM vendors"))
def vendor_deactivate(spark, d):
    v = mapped.vendors(spark, d)
    return ingest.deactivated(v, v.filter("vendor_id % 7 = 0").select("vendor_name"))


@named("SELECT (SELECT count(*) FROM customer) AS vendors, (SELECT count(*) FROM orders) AS records")
def ledger_counts(spark, d):
    v = mapped.vendors(spark, d).agg(F.count(F.lit(1)).alias("vendors"))
    return v.join(mapped.records(spark, d).agg(F.count(F.lit(1)).alias("records")))


# Matching and reconciling


def _ledger(spark, d):
    return candidates.ledger_of(mapped.records(spark, d), mapped.vendors(spark, d))


@named(sql("SELECT doc_id, record_id, reference, vendor_name, active, currency, amount_minor FROM tier1"))
def candidates_by_reference(spark, d):
    return candidates.by_reference(mapped.documents(spark, d), _ledger(spark, d))


@named(sql("SELECT d.doc_id, l.record_id FROM docs d JOIN ledger l ON l.vendor_name = d.vendor AND l.currency = d.currency AND l.amount_minor = d.amount_minor"))
def candidates_by_vendor_amount(spark, d):
    return candidates.by_vendor_amount(mapped.documents(spark, d), _ledger(spark, d)).select("doc_id", "record_id")


@named(sql("SELECT doc_id, record_id, tier FROM found"))
def candidates_tiered(spark, d):
    return candidates.tiered(mapped.documents(spark, d), _ledger(spark, d)).select("doc_id", "record_id", "tier")


def _verdicts(spark, d):
    docs = mapped.documents(spark, d)
    return reconcile.reconciled(docs, candidates.chosen(docs, _ledger(spark, d)))


@named(sql("SELECT doc_id, decision, record_id, variance_minor FROM verdicts"))
def reconcile_verdicts(spark, d):
    return _verdicts(spark, d).select("doc_id", "decision", "record_id", "variance_minor")


@named(sql("""SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS pos, unnest(['document is new', 'one record matches', 'vendor is active', 'currency agrees', 'amount agrees']) AS name, unnest([c1, c2, c3, c4, c5]) AS outcome FROM outcomes WHERE has_record
UNION ALL SELECT doc_id, unnest([0, 1]), unnest(['document is new', 'one record matches']), unnest([c1, 'fail']) FROM outcomes WHERE NOT has_record"""))
def reconcile_checks(spark, d):
    return _verdicts(spark, d).select("doc_id", F.posexplode_outer("checks").alias("pos", "k")).select("doc_id", "pos", "k.name", "k.outcome")  # outer: an inner one makes the checks twice, once to filter by their number


@named(sql("""SELECT doc_id, matches || ' records match equally well: ' || (SELECT string_agg(reference, ', ' ORDER BY x.record_id) FROM found x WHERE x.doc_id = b.doc_id) AS detail FROM best b WHERE matches > 1"""))
def contested_candidates(spark, d):
    one = _verdicts(spark, d).select("doc_id", F.get("checks", F.lit(1)).alias("k"))
    return one.filter("k.outcome = 'indeterminate'").select("doc_id", "k.detail")


_SIZES = "CASE WHEN variance_minor = 0 THEN 'none' WHEN abs(variance_minor) <= 2 THEN 'within the tolerance' WHEN abs(variance_minor) <= 100 THEN 'up to a unit' ELSE 'beyond' END"


@named(sql(f"""SELECT {_SIZES} AS size, count(*) AS n, min(variance_minor) AS least, max(variance_minor) AS most, CAST(sum(variance_minor) AS BIGINT) AS total, max(round(abs(variance_minor::DOUBLE / f.amount_minor), 9)) AS share
FROM verdicts v JOIN ledger f USING (record_id) WHERE variance_minor IS NOT NULL GROUP BY 1"""))
def variance_counts(spark, d):
    v = c("variance_minor")
    size = F.when(v == 0, "none").when(F.abs(v) <= numbers.TOLERANCE, "within the tolerance").when(F.abs(v) <= 100, "up to a unit").otherwise("beyond")
    return _verdicts(spark, d).filter(v.isNotNull()).groupBy(size.alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"), F.max(F.round(F.abs("variance_share"), 9)).alias("share")
    )


_EXPECTED = ("matched", "matched", "mismatch", "mismatch", "mismatch", "matched", "no-candidate", "indeterminate")
_PAIRS = "pairs AS (SELECT (['" + "', '".join(_EXPECTED) + "'])[(kind + 1)::INT] AS expected, decision AS actual FROM verdicts)"
_GRID = "(VALUES ('matched'), ('mismatch'), ('indeterminate'), ('no-candidate'))"


def _pairs(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _EXPECTED)), (c("doc_id") % 8 + 1).cast("int"))
    return _verdicts(spark, d).select(kind.alias("expected"), c("decision").alias("actual"))


@named(sql(f", {_PAIRS} SELECT e.v AS expected, a.v AS actual, count(p.actual) AS n FROM {_GRID} e(v) CROSS JOIN {_GRID} a(v) LEFT JOIN pairs p ON p.expected = e.v AND p.actual = a.v GROUP BY ALL"))
def verdict_confusion(spark, d):
    return scoring.confusion(_pairs(spark, d))


@named(sql(f", {_PAIRS} SELECT count(*) FILTER (actual = 'matched' AND expected <> 'matched') AS confidently_wrong, count(*) FILTER (actual = 'indeterminate' AND expected = 'matched') AS cost_of_abstention FROM pairs"))
def verdict_costs(spark, d):
    return scoring.costs(_pairs(spark, d))


# Identities


def _checked(spark, d):
    return identities.checked(mapped.amounts(spark, d))


def _one_identity(spark, d, name):
    rows = _checked(spark, d).select("doc_id", F.explode("identities").alias("i")).filter(c("i.name") == name)
    return rows.select("doc_id", "i.ok", "i.difference")


@named(sql(f"""SELECT '{identities.LINES}' AS name, count(d1) AS judged, count(*) FILTER (abs(d1) > 2) AS failed FROM differences
UNION ALL SELECT '{identities.TOTAL}', count(d2), count(*) FILTER (abs(d2) > 2) FROM differences UNION ALL SELECT '{identities.RATE}', count(d3), count(*) FILTER (abs(d3) > 2) FROM differences"""))
def identity_runs(spark, d):
    return identities.runs(_checked(spark, d))


@named(sql("SELECT doc_id, abs(d1) <= 2 AS ok, d1 AS difference FROM differences"))
def line_item_identity(spark, d):
    return _one_identity(spark, d, identities.LINES)


@named(sql("SELECT doc_id, abs(d2) <= 2 AS ok, d2 AS difference FROM differences WHERE d2 IS NOT NULL"))
def total_identity(spark, d):
    return _one_identity(spark, d, identities.TOTAL)


@named(sql("SELECT doc_id, abs(d3) <= 2 AS ok, d3 AS difference FROM differences WHERE d3 IS NOT NULL"))
def tax_rate_identity(spark, d):
    return _one_identity(spark, d, identities.RATE)


@named(sql(f""", rows AS (
  SELECT doc_id, 0 AS pos, '{identities.LINES}' AS name, abs(d1) <= 2 AS ok, unnest(['subtotal']) AS field FROM differences WHERE d1 IS NOT NULL
  UNION ALL SELECT doc_id, 1, '{identities.TOTAL}', abs(d2) <= 2, unnest(['subtotal', 'tax', 'total']) FROM differences WHERE d2 IS NOT NULL
  UNION ALL SELECT doc_id, 2, '{identities.RATE}', abs(d3) <= 2, unnest(['subtotal', 'tax']) FROM differences WHERE d3 IS NOT NULL)
SELECT doc_id, field, bool_and(ok) AS ok, arg_min(name, pos) FILTER (NOT ok) AS identity FROM rows GROUP BY ALL"""))
def identity_by_field(spark, d):
    return identities.by_field(_checked(spark, d))


# The gate


def _judged(spark, d):
    return gate.judged(mapped.fields(spark, d))


@named(sql("""SELECT doc_id, key, chk IS NULL AS admitted, chk AS "check", CASE WHEN chk IS NULL THEN CASE WHEN source IS NOT NULL THEN 'not applicable' ELSE 'passed' END END AS confidence_check,
  CASE WHEN chk IS NULL THEN CASE WHEN arithmetic_ok THEN 'passed' ELSE 'not checked' END END AS arithmetic FROM judged"""))
def gate_verdicts(spark, d):
    return _judged(spark, d).select("doc_id", "key", "verdict.admitted", "verdict.check", "verdict.confidence_check", "verdict.arithmetic")


@named(sql("""SELECT doc_id, count(*) FILTER (chk IS NULL) AS admitted, count(*) FILTER (chk IS NOT NULL) AS abstained, count(*) FILTER (chk IS NULL AND source IS NOT NULL) AS confidence_not_applicable,
  count(*) FILTER (chk = 'absent') AS by_absent, count(*) FILTER (chk = 'binding') AS by_binding, count(*) FILTER (chk = 'confidence') AS by_confidence, count(*) FILTER (chk = 'arithmetic') AS by_arithmetic FROM judged GROUP BY doc_id"""))
def gate_summary(spark, d):
    return gate.summary(_judged(spark, d))


@named(sql("""SELECT doc_id AS document_id, key, type, CASE WHEN type <> 'amount' THEN value END AS value_text, CASE WHEN type = 'amount' THEN value::BIGINT END AS value_minor, chk IS NULL AS admitted,
  chk AS check_failed, confidence, CASE WHEN chk IS NULL THEN status END AS width, source FROM judged"""))
def field_rows(spark, d):
    return documents.field_rows(_judged(spark, d))


# Scores

_FOUR = """count(*) FILTER (adm AND ok) AS admitted_right, count(*) FILTER (adm AND NOT ok) AS admitted_wrong, count(*) FILTER (NOT adm AND ok) AS abstained_would_be_right, count(*) FILTER (NOT adm AND NOT ok) AS abstained_would_be_wrong,
  count(*) AS fields, count(*) FILTER (adm) AS admitted, count(*) FILTER (adm)::DOUBLE / count(*) AS coverage, coalesce(count(*) FILTER (adm AND ok)::DOUBLE / nullif(count(*) FILTER (adm), 0), 0) AS precision"""


def _truth(spark, d):
    """What the page prints for each field, in the manner of its type; every tenth part is printed as another value."""
    x = mapped.fields(spark, d).select("doc_id", "key", "type").distinct().withColumn("part", F.split_part("key", F.lit("-"), F.lit(2)).cast("bigint"))
    part, wrong = c("part"), c("part") % 10 == 0
    number = F.when(wrong, part + 1).otherwise(part)
    day = F.date_add(F.lit("2020-01-01").cast("date"), (part % 1000).cast("int") + F.when(wrong, 1).otherwise(0))
    text_ = (
        F.when(c("type") == "string", F.concat(F.lit(" PART-"), number.cast("string"))).when(c("type") == "amount", F.concat(money.latin(number), F.lit(" EUR")))
        .when(c("type") == "date", F.date_format(day, "d MMMM yyyy")).otherwise(F.concat(F.lit(" "), number.cast("string"), F.lit("%")))
    )
    return x.select("doc_id", "key", text_.alias("text"))


_SCORED = """, once AS (SELECT DISTINCT doc_id, key FROM judged),
scored AS (SELECT j.doc_id, j.chk, j.chk IS NULL AS adm, coalesce(value IS NOT NULL AND l_partkey % 10 <> 0, FALSE) AS ok FROM once JOIN judged j USING (doc_id, key))
"""


@named(sql(_SCORED + f"SELECT {_FOUR} FROM scored"))
def extraction_score(spark, d):
    return scoring.extraction_totals(scoring.field_outcomes(_truth(spark, d), _judged(spark, d)))


@named(sql(_SCORED + f"SELECT doc_id, {_FOUR} FROM scored GROUP BY doc_id"))
def extraction_score_by_document(spark, d):
    return scoring.extraction_totals(scoring.field_outcomes(_truth(spark, d), _judged(spark, d)), ["doc_id"])


@named(sql(_SCORED + """SELECT chk AS "check", count(*) AS n FROM scored WHERE chk IS NOT NULL GROUP BY chk"""))
def abstentions_by_check(spark, d):
    return scoring.abstentions_by_check(scoring.field_outcomes(_truth(spark, d), _judged(spark, d)))


_FLOORS = (0.0, 0.25, 0.5, 0.75, 0.95)


@named(sql(f""", once AS (SELECT DISTINCT doc_id, key FROM fields), swept AS (
  SELECT f.floor, coalesce(j.value IS NOT NULL AND l_partkey % 10 <> 0, FALSE) AS ok, NOT (j.value IS NULL OR j.status = 'unbound' OR (j.source IS NULL AND coalesce(j.confidence < f.floor + (CASE WHEN j.status = 'span' THEN 0.15::DOUBLE ELSE 0 END), TRUE)) OR coalesce(NOT j.arithmetic_ok, FALSE)) AS adm
  FROM once JOIN fields j USING (doc_id, key) CROSS JOIN (VALUES {", ".join(f"({x}::DOUBLE)" for x in _FLOORS)}) f(floor))
SELECT floor, {_FOUR} FROM swept GROUP BY floor"""))
def risk_coverage(spark, d):
    return scoring.risk_coverage(_truth(spark, d), mapped.fields(spark, d), list(_FLOORS))


@named("""SELECT source, count(*) FILTER (p AND lang = CASE WHEN doc_id % 9 = 0 THEN 'en' ELSE lang END) AS correct, count(*) AS total FROM (SELECT *, doc_id % 5 <> 0 AS p FROM documents) GROUP BY source""")
def cell_score_by_field(spark, d):
    x = table(spark, d, "documents")
    actual = F.when(c("doc_id") % 9 == 0, "en").otherwise(c("lang"))
    return scoring.cells(x.select("source", c("lang").alias("expected"), actual.alias("actual"), (c("doc_id") % 5 != 0).alias("present")), ["source"])


@named("""SELECT event_type, count(value) FILTER (user_id % 3 <> 0) AS correct_n, min(value) FILTER (user_id % 3 <> 0) AS correct_min, max(value) FILTER (user_id % 3 <> 0) AS correct_max,
  count(value) FILTER (user_id % 3 = 0) AS incorrect_n, min(value) FILTER (user_id % 3 = 0) AS incorrect_min, max(value) FILTER (user_id % 3 = 0) AS incorrect_max,
  min(value) FILTER (user_id % 3 <> 0) > max(value) FILTER (user_id % 3 = 0) AS separable FROM events GROUP BY event_type""")
def confidence_separability(spark, d):
    x = table(spark, d, "events").select("event_type", (c("user_id") % 3 != 0).alias("correct"), c("value").alias("confidence"))
    return scoring.separability(x, ["event_type"]).drop("correct_mean", "incorrect_mean")


def _timed(spark, d):
    return table(spark, d, "events").select(c("event_type").alias("arm"), F.floor(c("value") * 1000).cast("bigint").alias("ms"))


_ARMS = "a AS (SELECT event_type AS arm, CAST(floor(quantile_cont(floor(value * 1000), 0.5) + 0.5) AS BIGINT) AS median, CAST(max(floor(value * 1000)) - min(floor(value * 1000)) AS BIGINT) AS spread FROM events GROUP BY event_type)"


@named(f"WITH {_ARMS} SELECT arm, median FROM a")
def latency_medians(spark, d):
    return scoring.medians(_timed(spark, d))


@named(f"WITH {_ARMS} SELECT max(median) - min(median) > max(spread) AS separable, max(median) - min(median) AS gap, max(spread) AS spread, arg_min(arm, (median, arm)) AS faster FROM a")
def latency_verdict(spark, d):
    return scoring.latency(_timed(spark, d))


def _trials(spark, d):
    """Orders as logged trials of a tool-calling run."""
    o = mapped.records(spark, d)
    k, amount = c("record_id"), c("amount_minor").cast("string")
    none = F.create_map().cast("map<string,string>")
    call = lambda turn, name, args, got: F.struct(F.lit(turn).alias("turn"), F.lit(name).alias("name"), args.alias("arguments"), got.alias("returned"), F.lit(None).cast("string").alias("error"))
    look = call(0, "lookup_record", none, F.create_map(F.lit("amount"), amount))
    b = F.when(k % 6 == 4, (c("amount_minor") + 7).cast("string")).otherwise(amount)
    diff = call(1, "compute_variance", F.create_map(F.lit("b"), b), F.create_map(F.lit("variance"), F.when(k % 6 == 5, "9").otherwise("0")))
    empty = F.array().cast(scoring.CALLS)
    calls = F.when(k % 6 == 2, empty).when(k % 6 == 3, F.array(look)).otherwise(F.array(look, diff)).cast(scoring.CALLS)
    stop = F.when(k % 6 == 1, F.when(k % 12 == 1, "turn-cap").otherwise("answered")).otherwise("answered")
    errors = F.when(k % 12 == 7, 1).otherwise(0)
    return o.select(k.alias("trial"), scoring.classify_calls(stop, errors, calls, F.lit("0")).alias("outcome"))


_TRIALS = """SELECT o_orderkey AS trial, CASE WHEN o_orderkey % 12 = 1 THEN 'turn-cap' WHEN o_orderkey % 12 = 7 THEN 'tool-error' WHEN o_orderkey % 6 = 2 THEN 'other' WHEN o_orderkey % 6 = 3 THEN 'step-omission'
  WHEN o_orderkey % 6 = 4 THEN 'result-substitution' WHEN o_orderkey % 6 = 5 THEN 'other' ELSE 'correct' END AS outcome FROM orders"""


@named(_TRIALS)
def trial_outcomes(spark, d):
    return _trials(spark, d)


@named(f"""WITH t AS ({_TRIALS}) SELECT o.v AS outcome, count(t.outcome) AS n, count(t.outcome)::DOUBLE / (SELECT count(*) FROM t) AS rate
FROM (VALUES ('correct'), ('step-omission'), ('result-substitution'), ('misreference'), ('tool-error'), ('turn-cap'), ('other')) o(v) LEFT JOIN t ON t.outcome = o.v GROUP BY o.v""")
def trial_outcome_counts(spark, d):
    return scoring.outcome_counts(_trials(spark, d))


def _slot_trials(spark, d):
    o = mapped.records(spark, d)
    k = c("record_id")
    step = lambda turn, action, refs, made: F.struct(F.lit(turn).alias("turn"), F.lit(action).alias("action"), refs.alias("references"), F.lit(made).cast("string").alias("produced"))
    pairs = lambda **x: F.create_map(*[y for a, b in x.items() for y in (F.lit(a), b if not isinstance(b, str) else F.lit(b))])
    look = step(0, "lookup_record", pairs(reference="doc.reference"), "record.amount")
    diff = step(1, "compute_variance", pairs(documentAmount=F.when(k % 5 == 3, "doc.tax").otherwise("doc.total"), recordAmount="record.amount"), "variance")
    report = step(2, "report", pairs(variance="variance"), None)
    steps = F.when(k % 5 == 2, F.array(look, report)).otherwise(F.array(look, diff, report)).cast(scoring.STEPS)
    stop = F.when(k % 5 == 0, F.when(k % 10 == 0, "turn-cap").otherwise("no-legal-action")).otherwise("terminal")
    wanted = {"lookup_record": {"reference": "doc.reference"}, "compute_variance": {"documentAmount": "doc.total", "recordAmount": "record.amount"}}
    return o.select(k.alias("trial"), scoring.classify_steps(stop, steps, F.when(k % 5 == 4, 1).otherwise(0), F.lit(0), wanted).alias("outcome"))


@named("""SELECT o_orderkey AS trial, CASE WHEN o_orderkey % 10 = 0 THEN 'turn-cap' WHEN o_orderkey % 5 = 0 THEN 'other' WHEN o_orderkey % 5 = 2 THEN 'step-omission' WHEN o_orderkey % 5 = 3 THEN 'misreference'
  WHEN o_orderkey % 5 = 4 THEN 'other' ELSE 'correct' END AS outcome FROM orders""")
def slot_trial_outcomes(spark, d):
    return _slot_trials(spark, d)


@named("SELECT o_custkey, count(*) AS trials, round(CASE WHEN count(*) = 0 THEN 1 ELSE 1 - pow(1 - 0.95::DOUBLE, 1.0::DOUBLE / count(*)) END, 9) AS bound FROM orders GROUP BY o_custkey")
def upper_bound_zero(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("trials"))
    return n.select("o_custkey", "trials", F.round(scoring.upper_bound_without_failures(c("trials")), 9).alias("bound"))


@named("""WITH RECURSIVE t AS (SELECT o_custkey, count(*) AS trials, count(*) FILTER (o_orderstatus = 'F') AS failures FROM orders GROUP BY 1),
b AS (SELECT DISTINCT trials AS n, failures AS f, failures / trials::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM t WHERE failures < trials
UNION ALL SELECT n, f, CASE WHEN tail > 0.05 THEN mid ELSE lo END, CASE WHEN tail > 0.05 THEN hi ELSE mid END, i + 1 FROM (
  SELECT *, list_sum(list_transform(range(0, f + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(mid) + (n - k) * ln(1 - mid)))) AS tail FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 45)))
SELECT o_custkey, trials, failures, round(coalesce((lo + hi) / 2, 1.0), 6) AS bound FROM t LEFT JOIN b ON n = trials AND f = failures AND i = 45""")
def upper_bounds(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("trials"), F.count_if(c("o_orderstatus") == "F").alias("failures"))
    return n.withColumn("bound", F.round(scoring.upper_bounds(c("failures"), c("trials")), 6))


@named("""SELECT user_id::VARCHAR AS model, count(*) AS runs, sum(event_id)::BIGINT AS bytes, sum(CAST(floor(value * 1000) AS BIGINT))::BIGINT AS ms, round(avg(CASE WHEN event_id % 3 = 0 THEN value END), 6) AS tok_per_sec,
  sum(event_id % 5)::BIGINT AS correct, (count(*) * 5)::BIGINT AS total FROM events GROUP BY user_id""")
def model_lineup(spark, d):
    x = table(spark, d, "events").select(
        c("user_id").cast("string").alias("model"), c("event_id").alias("bytes"), F.floor(c("value") * 1000).cast("bigint").alias("ms"), F.when(c("event_id") % 3 == 0, c("value")).alias("tok_per_sec"),
        (c("event_id") % 5).alias("correct"), F.lit(5).cast("bigint").alias("total"),
    )
    return scoring.lineup(x).withColumn("tok_per_sec", F.round("tok_per_sec", 6))


@named("""WITH x AS (SELECT event_id, value / 100 AS profiled, CASE WHEN event_id % 4 = 0 THEN value * 100 + 900 ELSE value * 10 + event_id % 7 END AS wall FROM events), y AS (SELECT *, floor(profiled * 1000 + 0.5) AS ms FROM x)
SELECT event_id, CAST(CASE WHEN abs(ms - wall) < wall * 0.5 + 250 THEN ms ELSE floor(wall + 0.5) END AS BIGINT) AS ms, CASE WHEN abs(ms - wall) < wall * 0.5 + 250 THEN 'profiler-raw' ELSE 'wall-clock' END AS source,
  floor(profiled * 1000 + 0.5) / 1000 AS seconds FROM y""")
def timed_calls(spark, d):
    wall = F.when(c("event_id") % 4 == 0, c("value") * 100 + 900).otherwise(c("value") * 10 + c("event_id") % 7)
    x = table(spark, d, "events").select("event_id", numbers.milliseconds(c("value") / 100, wall).alias("m"), numbers.rounded3(c("value") / 100).alias("seconds"))
    return x.select("event_id", "m.ms", "m.source", "seconds")


# Documents and traces


@named("""WITH x AS (SELECT sha256(text) AS digest, 'doc/' || lpad(doc_id::VARCHAR, 12, '0') AS path, source AS route, doc_id AS read_at FROM documents),
k AS (SELECT digest FROM x WHERE read_at % 10 = 0)
SELECT digest, arg_min(path, (read_at, path)) AS path, arg_min(route, (read_at, path)) AS route, min(read_at) AS read_at FROM x WHERE digest NOT IN (SELECT digest FROM k) GROUP BY digest""")
def document_digest_dedupe(spark, d):
    x = mapped.digests(spark, d)
    known = x.filter("read_at % 10 = 0").select("digest").distinct()
    return documents.unseen(x, known).select("digest", "path", "route", "read_at")


@named("SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0) AS seen FROM documents")
def wasreconciled_semi(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    stored = x.select(c("doc_id").alias("id"), "digest")
    done = x.filter("doc_id % 4 = 0").select(c("doc_id").alias("document_id"))
    return documents.reconciled_before(x, stored, done).select("doc_id", "seen")


@named("SELECT user_id AS document_id, max(event_id) AS id, arg_max(event_type, event_id) AS decision FROM events GROUP BY user_id")
def latest_reconciliation(spark, d):
    x = table(spark, d, "events").select(c("event_id").alias("id"), c("user_id").alias("document_id"), c("event_type").alias("decision"))
    return documents.latest(x)


@named("""WITH x AS (SELECT page_id, page_id % 6 AS k, length(html) AS n, 5000000 * (page_id % 7) AS bytes FROM pages),
y AS (SELECT *, CASE WHEN bytes > 26214400 THEN 'PDF is ' || round(bytes / 1e6)::BIGINT || ' MB, too large to parse safely' WHEN k = 3 THEN 'bad xref' END AS failure, CASE WHEN n < 2000 THEN n % 40 + 1 ELSE 199 END AS chars FROM x)
SELECT page_id, CASE WHEN k = 0 THEN 'unsupported' WHEN k = 1 THEN 'image' WHEN k = 2 THEN 'unsupported' WHEN failure IS NOT NULL OR chars < 120 THEN 'pdf-needs-render' ELSE 'text' END AS kind,
  CASE WHEN k = 0 THEN 'file not found' WHEN k = 2 THEN 'unsupported file type ' || CASE WHEN page_id % 12 = 2 THEN '(none)' ELSE '.docx' END
    WHEN k > 2 AND failure IS NOT NULL THEN 'text extraction failed (' || failure || ')' WHEN k > 2 AND chars < 120 THEN 'only ' || chars || ' characters of text, treating it as a scan' END AS reason,
  CASE WHEN k > 2 AND failure IS NULL AND chars >= 120 THEN 199 END AS shown FROM y""")
def route_documents(spark, d):
    k, n = c("page_id") % 6, F.length("html")
    files = table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("in/"), c("page_id").cast("string"), F.when(k == 1, ".PNG").when(k == 2, F.when(c("page_id") % 12 == 2, "").otherwise(".docx")).otherwise(".pdf")).alias("path"), (k != 0).alias("exists"),
        (F.lit(5_000_000) * (c("page_id") % 7)).cast("bigint").alias("length"), F.when(k == 3, "bad xref").alias("failure"),
        F.when(n < 2000, F.concat(F.lit("  "), F.repeat(F.lit("x"), (n % 40 + 1).cast("int")), F.lit("\n\n\n"))).otherwise(F.repeat(F.lit("word \t "), 40)).alias("text"),
    )
    return documents.routed(files).select("page_id", "kind", "reason", F.length("page_text").alias("shown"))


def trace_records_of(x):
    """The conversations' turns as trace records, batch or stream."""
    body = F.concat(F.lit('{"action":"'), c("role"), F.lit('","digest":"'), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit('","reads":[],"stage":"turn-'), c("turn").cast("string"), F.lit('","writes":"text"}'))
    return x.select(c("conv_id").alias("run_id"), c("turn").cast("bigint").alias("pos"), body.alias("body"))


def _records(spark, d):
    return trace_records_of(table(spark, d, "conversations"))


_CHAIN = f"""WITH r AS (SELECT conv_id AS run_id, list('{{"action":"' || role || '","digest":"' || sha256(coalesce(text, '')) || '","reads":[],"stage":"turn-' || turn || '","writes":"text"}}' ORDER BY turn) AS b FROM conversations GROUP BY conv_id)
SELECT run_id, list_reduce(list_prepend(sha256('{trace.GENESIS}'), b), lambda h, x: sha256(h || x)) AS root"""


@named(_CHAIN + " FROM r")
def trace_chain(spark, d):
    return trace.chained(_records(spark, d)).select("run_id", "root")


@named("SELECT conv_id AS run_id, bool_and(NOT (turn = 1 AND conv_id % 3 = 0)) AS ok, CASE WHEN conv_id % 3 = 0 AND bool_or(turn = 1) THEN 1 END AS broken_at FROM conversations GROUP BY conv_id")
def trace_broken_at(spark, d):
    r = _records(spark, d)
    heads = trace.chained(r).select("run_id", F.posexplode("heads").alias("pos", "head"))
    r = r.join(heads.withColumn("pos", c("pos").cast("bigint")), ["run_id", "pos"])
    r = r.withColumn("body", F.when((c("pos") == 1) & (c("run_id") % 3 == 0), F.concat("body", F.lit(" "))).otherwise(c("body")))
    return trace.broken_at(r).select("run_id", "ok", "broken_at")


# Certificates' set rules and differences


@named("""WITH s AS (SELECT l_orderkey AS id, coalesce(list(DISTINCT l_partkey) FILTER (l_returnflag = 'N'), []) AS f, coalesce(list(DISTINCT l_partkey) FILTER (l_returnflag = 'R'), []) AS a, coalesce(list(DISTINCT l_partkey) FILTER (l_linenumber <= 4), []) AS d FROM lineitem GROUP BY 1)
SELECT id, len(list_intersect(f, a)) AS in_both, len(list_filter(d, lambda x: NOT list_contains(list_concat(f, a), x))) AS unaccounted,
  CASE WHEN len(d) > 0 THEN len(list_filter(list_distinct(list_concat(f, a)), lambda x: NOT list_contains(d, x))) ELSE 0 END AS undeclared FROM s""")
def section_rules(spark, d):
    x = table(spark, d, "lineitem")
    of = lambda cond: F.collect_set(F.when(cond, c("l_partkey").cast("string")))
    s = x.groupBy(c("l_orderkey").alias("id")).agg(of(c("l_returnflag") == "N").alias("f"), of(c("l_returnflag") == "R").alias("a"), of(c("l_linenumber") <= 4).alias("declared"))
    fields = F.map_from_arrays("f", F.transform("f", lambda k: k))
    s = s.select("id", F.struct(fields.alias("fields"), F.transform("a", lambda k: F.struct(k.alias("key"))).alias("abstentions"), "declared").alias("c"))
    return certificates.set_problems(s).select("id", *[F.size(k).cast("bigint").alias(k) for k in ("in_both", "unaccounted", "undeclared")])


@named("""WITH a AS (SELECT c_custkey::VARCHAR AS id, unnest(['name', 'at.segment', 'balance[0]']) AS path, unnest(['"' || c_name || '"', '"' || c_mktsegment || '"', c_nationkey::VARCHAR]) AS recorded FROM customer),
b AS (SELECT c_custkey::VARCHAR AS id, unnest(['name', 'at.segment', 'nation']) AS path, unnest(['"' || c_name || '"', '"' || CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END || '"', c_nationkey::VARCHAR]) AS regenerated FROM customer)
SELECT id, path, recorded, regenerated FROM a FULL JOIN b USING (id, path) WHERE recorded IS DISTINCT FROM regenerated""")
def replay_diff(spark, d):
    x = table(spark, d, "customer")
    id_, at = c("c_custkey").cast("string").alias("id"), lambda v: F.struct(v.alias("segment")).alias("at")
    a = x.select(id_, F.to_json(F.struct(c("c_name").alias("name"), at(c("c_mktsegment")), F.array("c_nationkey").alias("balance"), F.lit("then").alias("producedAt"))).alias("certificate"))
    other = F.when(c("c_custkey") % 5 == 0, "OTHER").otherwise(c("c_mktsegment"))
    b = x.select(id_, F.to_json(F.struct(at(other), c("c_nationkey").alias("nation"), c("c_name").alias("name"), F.lit("now").alias("producedAt"))).alias("certificate"))
    return certificates.differences(a, b)


# Plans


@named(sql("""SELECT o_orderkey AS run_id, (['lookup_record', NULL, 'compute_variance', 'report'])[(o_orderkey % 4 + 1)::INT] AS action FROM orders WHERE o_orderkey % 4 IN (2, 3)
UNION ALL SELECT o_orderkey, 'lookup_record' FROM orders WHERE o_orderkey % 4 IN (0, 1)"""))
def legal_actions(spark, d):
    return planner.legal(mapped.slots(spark, d), planner.actions(spark))


@named(sql("""SELECT run_id, p.action, p.param, key FROM slots s JOIN (VALUES ('lookup_record', 'reference', 'string', 'document-asserted'), ('compute_variance', 'documentAmount', 'amount', 'document-asserted'),
  ('compute_variance', 'recordAmount', 'amount', 'source-attested'), ('report', 'variance', 'amount', 'host-computed')) p(action, param, t, pr) ON s.type = p.t AND s.provenance = p.pr"""))
def admissible_slots(spark, d):
    return planner.admissible(mapped.slots(spark, d), planner.actions(spark)).select("run_id", "action", "param", "key")


@named(sql("""SELECT s.run_id, any_value(s.minor) - any_value(r.amount_minor) AS variance, CASE WHEN any_value(s.minor) IS NULL OR any_value(r.amount_minor) IS NULL THEN 'no-legal-action' ELSE 'terminal' END AS stop_reason
FROM (SELECT run_id, any_value(CASE WHEN seq = 1 THEN minor END) AS minor FROM slots GROUP BY run_id) s
LEFT JOIN (SELECT reference_key, arg_min(amount_minor, record_id) AS amount_minor FROM ledger GROUP BY reference_key) r ON r.reference_key = 'po' || s.run_id GROUP BY s.run_id"""))
def planned_variance(spark, d):
    ledger = mapped.records(spark, d).select("record_id", text.reference_key(c("reference")).alias("reference_key"), "amount_minor")
    return planner.carried_out(mapped.slots(spark, d), ledger)


# Geometry

_BOX = "l_linenumber * 10.0::DOUBLE AS ax0, l_quantity AS ay0, l_linenumber * 10.0::DOUBLE + l_quantity AS ax1, l_quantity + 20 AS ay1, l_linenumber * 10.0::DOUBLE + l_discount * 100 AS bx0, l_quantity + l_linenumber::DOUBLE AS by0, l_linenumber * 10.0::DOUBLE + l_discount * 100 + l_quantity - 5 AS bx1, l_quantity + l_linenumber::DOUBLE + 12 AS by1"


@named(f"""SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part, round(CASE WHEN least(ay1 - ay0, by1 - by0) <= 0 THEN 0 ELSE greatest(0, least(ay1, by1) - greatest(ay0, by0)) / least(ay1 - ay0, by1 - by0) END, 9) AS overlap,
  round((bx0 - ax1) / greatest(ay1 - ay0, by1 - by0), 9) AS gap FROM (SELECT *, {_BOX} FROM lineitem)""")
def bbox_overlap_gap(spark, d):
    b = mapped.boxes(spark, d)
    return b.select("doc_id", "line", "part", F.round(geometry.v_overlap(c("a"), c("b")), 9).alias("overlap"), F.round(geometry.h_gap(c("a"), c("b")), 9).alias("gap"))


@named(f"""WITH x AS (SELECT *, {_BOX} FROM lineitem), y AS (SELECT *, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS i FROM x),
z AS (SELECT *, (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - i AS u FROM y)
SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part, round(CASE WHEN u <= 0 THEN 0 ELSE i / u END, 9) AS iou FROM z""")
def bbox_iou(spark, d):
    return mapped.boxes(spark, d).select("doc_id", "line", "part", F.round(geometry.iou(c("a"), c("b")), 9).alias("iou"))


# Logs


@named("""SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type AS op, (user_id % 3)::VARCHAR AS model, count(*) AS calls, count(*) FILTER (event_id % 17 = 0) AS failures, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS total_ms FROM events GROUP BY ALL""")
def inference_log_windows(spark, d):
    none = F.lit(None).cast("bigint")
    x = table(spark, d, "events").select(
        "ts", c("event_type").alias("op"), (c("user_id") % 3).cast("string").alias("model"), F.floor(c("value") * 1000).cast("bigint").alias("gen_ms"), none.alias("ocr_ms"), none.alias("load_ms"),
        F.lit(None).cast("double").alias("tok_per_sec"), F.when(c("event_id") % 17 == 0, "failed").alias("error"),
    )
    return by_window(x).drop("tok_per_sec")
