"""The operators on small inputs with known answers."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.geometry import BOX
from ledgerloom.functions import text
from ledgerloom.functions import values as values_of
from ledgerloom.operators import binding, candidates, certificates, documents, gate, identities, ingest, layout, planner, reconcile, run, scoring, signing, trace
from ledgerloom.schemas import INVOICE, REGIONS
from ledgerloom.sources import delimited, files, sinks
from ledgerloom.streaming import logs

# Sources and ingestion


def test_sniff_and_grid():
    assert delimited.sniffed('a;b\n"x,y,z,w";2\n') == ";"
    assert delimited.sniffed("nothing here") == ","
    rows = lambda t, d=",": list(delimited.grid(t, d))
    assert rows('a,b\r\n"x ""q"", y",2\n') == [["a", "b"], ['x "q", y', "2"]]
    assert rows('"two\nlines",b') == [["two\nlines", "b"]]
    assert rows("a,b\n\nc,d\n") == [["a", "b"], [""], ["c", "d"]]
    assert rows('a"b,c"d,e') == [["ab,cd", "e"]]
    assert rows('"",x\n') == [["", "x"]]
    assert rows("") == [] and rows("a,") == [["a", ""]]
    with pytest.raises(ValueError, match="at byte 2"):
        delimited.decoded(b"ab\xff")


def test_read_cells_and_import(spark, tmp_path):
    (tmp_path / "broken.csv").write_bytes(b"\xef\xbb\xbfreference;vendor;amount;date\r\nR1;Acme;EUR 1.234,50;2026-05-18\r\nR2;Acme;x;\r\nR3;Acme;5;\r\nR1;Acme;EUR 7;\r\nR4;Acme;EUR 9;14/03/2026\r\nR5;Acme\r\n")
    (tmp_path / "bad.csv").write_bytes(b"a,b\n\xff")
    cells = delimited.read_cells(spark, f"{tmp_path}/*.csv").cache()
    assert [r["error"] for r in cells.filter("error is not null").collect()] == ["file is not valid UTF-8 at byte 4"]
    good = cells.filter("error is null")
    header = good.filter("line = 1").collect()[0]
    assert header["had_bom"] and header["delimiter"] == ";"
    mapping = ingest.proposed_mapping(header["cells"])
    assert mapping == {"reference": 0, "vendor": 1, "amount": 2, "currency": None, "issued_on": 3}
    done = ingest.validated(ingest.mapped(good, mapping)).cache()
    ok = ingest.accepted(done).collect()
    assert [(r["line"], r["reference"], r["currency"], int(r["amount_minor"]), r["issued_on"]) for r in ok] == [(2, "R1", "EUR", 123450, "2026-05-18")]
    assert {r["line"]: r["reason"] for r in ingest.rejected(done, ";").collect()} == {
        3: 'amount is not a number: "x"', 4: "no currency in the row and none in the amount", 5: "duplicate reference, first seen at line 2",
        6: 'date is not readable: "14/03/2026"', 7: "row has 2 cells and the header has 4",
    }
    assert ingest.proposed_mapping(["foo", "bar"]) == dict.fromkeys(ingest.FIELDS)


def test_load_ledger(spark, tmp_path):
    vendors = spark.createDataFrame([(1, "Acme", True), (4, "Old", True)], "vendor_id bigint, vendor_name string, active boolean")
    records = spark.createDataFrame([(7, 1, "R1")], "record_id bigint, vendor_id bigint, reference string")
    rows = spark.createDataFrame([(2, "R1", "Acme", "EUR", 5, None), (3, "R2", "Acme", "EUR", 6, None), (4, "R1", "New", "EUR", 7, None), (5, "R2", "Acme", "EUR", 8, None)], "line int, reference string, vendor string, currency string, amount_minor bigint, issued_on string")
    v, r, s = sinks.import_rows(rows, vendors, records, str(tmp_path))
    assert [(x["vendor_id"], x["vendor_name"]) for x in v.collect()] == [(5, "New")]
    assert sorted((x["record_id"], x["vendor_id"], x["reference"], x["amount_minor"]) for x in r.collect()) in ([(8, 1, "R2", 6), (9, 5, "R1", 7)], [(8, 5, "R1", 7), (9, 1, "R2", 6)])
    assert sorted((x["line"], x["reason"]) for x in s.collect()) == [(2, "already in the ledger"), (5, "already in the ledger")]
    off = ingest.deactivated(vendors, spark.createDataFrame([("Old",)], "vendor_name string"))
    assert {x["vendor_name"]: x["active"] for x in off.collect()} == {"Acme": True, "Old": False}


def test_coerced_fields(spark):
    template = spark.createDataFrame([r[:3] for r in INVOICE], "pos int, key string, type string")
    raw = spark.createDataFrame([("d", {"total": "2.831,40", "tax": "Jund", "date": "not a date", "tax_rate": "many", "vendor": " Acme ", "currency": "", "extra": "1"})], "doc_id string, fields map<string,string>")
    got = {r["key"]: (r["status"], r["value"]) for r in ingest.coerced_fields(raw, template).collect()}
    assert got == {
        "vendor": ("ok", "Acme"), "invoice_no": ("absent", None), "date": ("rejected", None), "subtotal": ("absent", None), "tax": ("rejected", None), "tax_rate": ("rejected", None),
        "total": ("ok", "283140"), "currency": ("absent", None), "extra": ("rejected", None),
    }


# Matching


LEDGER = "record_id bigint, reference string, reference_key string, vendor_name string, active boolean, currency string, amount_minor bigint"
DOC = "doc_id string, reference string, vendor string, currency string, amount_minor bigint, seen boolean, currency_state string, currency_by string, total bigint, total_state string, total_by string"


def _reconciled(spark, docs, ledger):
    d = spark.createDataFrame([(k, ref, v, cur, t, seen, cs, None, t, ts, None) for k, ref, v, cur, t, seen, cs, ts in docs], DOC)
    x = spark.createDataFrame(ledger, LEDGER)
    return {r["doc_id"]: r for r in reconcile.reconciled(d, candidates.chosen(d, x)).collect()}


def test_reconcile(spark):
    ledger = [(1, "NW-2026-0117", "nw20260117", "Acme", True, "EUR", 52381), (2, "PO-1", "po1", "Beta", False, "EUR", 100), (3, "S", "s", "C", True, "EUR", 5), (4, "S", "s", "D", True, "EUR", 5)]
    nw = "NW 2026 0117"
    docs = [
        ("exact", nw, "x", "eur", 52381, False, "have", "have"), ("cents", nw, "x", "EUR", 52383, False, "have", "have"), ("off", nw, "x", "EUR", 52481, False, "have", "have"),
        ("usd", nw, "x", "USD", 52381, False, "have", "have"), ("held", nw, "x", "EUR", 52381, False, "have", "withheld"), ("tier2", None, "Beta", "EUR", 100, False, "have", "have"),
        ("amount only", None, None, None, 100, False, "have", "have"), ("many", "s", "x", "EUR", 5, False, "have", "have"), ("seen", nw, "x", "EUR", 52381, True, "have", "have"),
        ("seen, none", "zz", "x", "EUR", 52381, True, "have", "have"), ("no currency", nw, "x", None, 52381, False, "missing", "have"),
    ]
    got = _reconciled(spark, docs, ledger)
    assert {k: r["decision"] for k, r in got.items()} == {
        "exact": "matched", "cents": "matched", "off": "mismatch", "usd": "mismatch", "held": "indeterminate", "tier2": "mismatch", "amount only": "no-candidate", "many": "indeterminate",
        "seen": "mismatch", "seen, none": "no-candidate", "no currency": "indeterminate",
    }
    assert got["off"]["variance_minor"] == 100 and got["usd"]["variance_minor"] is None and got["held"]["variance_minor"] is None
    assert got["many"]["checks"][1]["detail"] == "2 records match equally well: S, S" and got["many"]["record_id"] == 3
    assert got["off"]["checks"][4]["detail"] == "document 52481 against record 52381, variance 100 minor units"
    assert [c["name"] for c in got["seen, none"]["checks"]] == ["document is new", "one record matches"]


def test_identities(spark):
    rows = [("ok", 43290, 9091, 52381, 21, 43290), ("tax", 43290, 4329, 47619, 21, None), ("no rate", 43290, 9091, 52381, None, None), ("lines", 100, 0, 100, None, 150), ("negative", -43290, -9090, -52380, 21, None)]
    df = identities.checked(spark.createDataFrame(rows, "doc_id string, subtotal bigint, tax bigint, total bigint, tax_rate bigint, lines bigint")).cache()
    got = {r["doc_id"]: {i["name"]: i["ok"] for i in r["identities"]} for r in df.collect()}
    assert got["ok"] == {identities.LINES: True, identities.TOTAL: True, identities.RATE: True}
    assert got["tax"] == {identities.TOTAL: True, identities.RATE: False} and identities.RATE not in got["no rate"] and got["negative"][identities.RATE]
    fields = {(r["doc_id"], r["field"]): (r["ok"], r["identity"]) for r in identities.by_field(df).collect()}
    assert fields["lines", "subtotal"] == (False, identities.LINES) and fields["lines", "total"] == (True, None) and fields["tax", "tax"] == (False, identities.RATE)


def test_gate(spark):
    rows = [
        ("a", None, "string", "region", None, 0.9, None), ("b", "x", "string", "unbound", None, None, None), ("c", "d", "date", "span", None, 0.866, None), ("d", "d", "date", "span", None, 0.45, None),
        ("e", "d", "date", "region", None, 0.45, None), ("f", "x", "string", "region", None, None, None), ("g", "x", "amount", "region", "text-layer", None, True), ("h", "x", "amount", "region", None, 0.5, False), ("i", "x", "amount", "region", None, 0.4999, None),
    ]
    df = gate.judged(spark.createDataFrame([("doc", *r) for r in rows], "doc_id string, key string, value string, type string, status string, source string, confidence double, arithmetic_ok boolean")).cache()
    got = {r["key"]: r["verdict"]["check"] or "admitted" for r in df.collect()}
    assert got == {"a": "absent", "b": "binding", "c": "admitted", "d": "confidence", "e": "admitted", "f": "confidence", "g": "admitted", "h": "arithmetic", "i": "confidence"}
    s = gate.summary(df).collect()[0]
    assert (s["admitted"], s["abstained"], s["confidence_not_applicable"], s["by_confidence"]) == (3, 6, 1, 3)
    why = df.select("key", gate.reason(F.col("verdict.check"), F.col("status"), F.col("type"), F.col("confidence"), F.lit(None).cast("string"), F.lit("total")).alias("r")).collect()
    assert {r["key"]: r["r"] for r in why}["d"] == "read at 0.450, below the 0.55 floor for a date bound at span width"


# Pages


def _regions(spark, rows):
    return spark.createDataFrame([(d, i, t, b, conf, src) for d, i, t, b, conf, src in rows], REGIONS)


def test_layout(spark):
    page = [
        ("p", 0, "40", (876.0, 545.0, 924.0, 579.0), 0.99, None), ("p", 1, "491,", (843.6, 544.9, 880.0, 579.8), 0.982, "x"), ("p", 2, "Total", (10.0, 546.0, 90.0, 580.0), None, None),
        ("p", 3, "120,00", (10.0, 700.0, 90.0, 730.0), 0.9, None), ("p", 4, "1.200,00", (95.0, 700.0, 190.0, 730.0), 0.9, None), ("p", 5, "loose", None, None, None), ("q", 0, "alone", (0.0, 0.0, 5.0, 5.0), None, None),
    ]
    r = _regions(spark, page)
    rows = {(x["doc_id"], x["idx"]): (x["row_id"], x["pos"]) for x in layout.clustered(r).collect()}
    assert rows[("p", 2)] == (0, 0) and rows[("p", 1)] == (0, 1) and rows[("p", 0)] == (0, 2) and rows[("p", 3)] == (1, 0) and rows[("p", 5)] == (None, None)
    joined = [x for x in layout.joined_numbers(r).orderBy("doc_id", "idx").collect() if x["doc_id"] == "p"]
    assert [x["text"] for x in joined] == ["Total", "491,40", "120,00", "1.200,00", "loose"]
    assert tuple(joined[1]["bbox"]) == (843.6, 544.9, 924.0, 579.8) and joined[1]["confidence"] == 0.982 and joined[1]["source"] is None
    assert {x["doc_id"]: x["text"] for x in layout.page_text(r).collect()} == {"p": "Total  491,  40\n120,00  1.200,00", "q": "alone"}
    assert [x["text"] for x in layout.reading_order(r).filter("doc_id = 'p'").orderBy("place").collect()][-1] == "loose"


def test_binding(spark):
    page = [
        ("d", 0, "Subtotal", (0.0, 0.0, 50.0, 10.0), 0.9, None), ("d", 1, "105,00", (60.0, 0.0, 90.0, 10.0), 0.8, None), ("d", 2, "Total due", (0.0, 40.0, 50.0, 50.0), 0.9, None),
        ("d", 3, "105,00", (60.0, 40.0, 90.0, 50.0), 0.7, None), ("d", 4, "Date: 18 May 2026", (0.0, 80.0, 90.0, 90.0), 0.6, None), ("d", 5, "Northwind", (0.0, 120.0, 40.0, 130.0), 0.5, None), ("d", 6, "Paper", (45.0, 120.0, 80.0, 130.0), 0.4, None),
    ]
    vals = [("d", "total", "amount", "10500"), ("d", "date", "date", "2026-05-18"), ("d", "vendor", "string", "Northwind Paper"), ("d", "tax", "amount", "99"), ("d", "currency", "string", None), ("e", "total", "amount", "5")]
    v = spark.createDataFrame(vals, "doc_id string, key string, type string, value string")
    labels = spark.createDataFrame([("total", "Total due")], "key string, label string")
    got = {(r["doc_id"], r["key"]): r for r in binding.bound(v, _regions(spark, page), labels).collect()}
    total = got["d", "total"]
    assert total["status"] == "region" and total["contested"] == 2 and total["bbox"]["y0"] == 40.0 and total["confidence"] == 0.7
    assert got["d", "date"]["status"] == "span" and got["d", "date"]["text"] == "Date: 18 May 2026"
    assert got["d", "vendor"]["status"] == "span" and got["d", "vendor"]["confidence"] == 0.4 and tuple(got["d", "vendor"]["bbox"]) == (0.0, 120.0, 80.0, 130.0)
    assert got["d", "tax"]["reason"] == binding.NOT_FOUND and got["d", "currency"]["reason"] == binding.ABSENT and got["e", "total"]["reason"] == binding.NO_REGIONS
    first = {r["key"]: r for r in binding.bound(v.filter("key = 'total' and doc_id = 'd'"), _regions(spark, page)).collect()}
    assert first["total"]["bbox"]["y0"] == 0.0


# Documents, files, scores


def test_documents(spark, tmp_path):
    docs = spark.createDataFrame([("a", "p2", "text", 2), ("a", "p1", "text", 1), ("b", "p3", "image", 3)], "digest string, path string, route string, read_at int")
    new = documents.unseen(docs, spark.createDataFrame([("b",)], "digest string")).collect()
    assert [(r["digest"], r["path"]) for r in new] == [("a", "p1")]
    files_ = [("x.PNG", True, 5, None, None), ("x.pdf", True, 5, "w " * 200, None), ("x.pdf", True, 5, "short", None), ("x.pdf", True, 30 * 2**20, "w " * 200, None), ("x.pdf", True, 5, None, "bad xref"), ("x.doc", True, 5, None, None), ("y.pdf", False, 0, None, None)]
    kinds = documents.routed(spark.createDataFrame(files_, "path string, exists boolean, length bigint, text string, failure string")).collect()
    assert [r["kind"] for r in kinds] == ["image", "text", "pdf-needs-render", "pdf-needs-render", "pdf-needs-render", "unsupported", "unsupported"]
    assert [r["reason"] for r in kinds] == [
        None, None, "only 5 characters of text, treating it as a scan", "text extraction failed (PDF is 31 MB, too large to parse safely)", "text extraction failed (bad xref)", "unsupported file type .doc", "file not found",
    ]
    (tmp_path / "one").write_bytes(b"abc")
    (tmp_path / "two").write_bytes(b"abd")
    wanted = spark.createDataFrame([("ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad",)], "digest string")
    assert files.find_by_digest(spark, str(tmp_path), wanted).count() == 1
    known = spark.createDataFrame([], "id bigint, digest string")
    put = sinks.put_documents(docs.withColumn("read_at", F.current_timestamp()), known, f"{tmp_path}/docs").collect()
    assert sorted(r["id"] for r in put) == [1, 2] and spark.read.parquet(f"{tmp_path}/docs").count() == 2


def test_regions_source(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps([{"text": "a", "bbox": [1, 2, 3, 4], "confidence": 0.5}, {"text": "b"}]))
    rows = files.regions(spark, str(tmp_path)).orderBy("idx").collect()
    assert rows[0]["doc_id"] == "page" and tuple(rows[0]["bbox"]) == (1, 2, 3, 4) and rows[1]["bbox"] is None


def test_scores(spark):
    many = scoring.upper_bound([0, 0, 1, 10, 500, 100_000, 3], [10, 0, 10, 10, 2000, 1_000_000, 1_000_000])
    assert abs(many[0] - 0.2588655508) < 1e-9 and many[1] == many[3] == 1 and 0.39 < many[2] < 0.4 and 0.1004 < many[5] < 0.1006 and 7e-6 < many[6] < 8e-6
    tail = lambda f, n, p: sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(f + 1))
    assert abs(tail(500, 2000, many[4]) - 0.05) < 1e-9 and abs(tail(3, 1_000_000, many[6]) - 0.05) < 1e-9
    df = spark.createDataFrame([(0, 10), (1, 10)], "f int, n int").select(scoring.upper_bounds(F.col("f"), F.col("n")).alias("b"), scoring.upper_bound_without_failures(F.col("n")).alias("z")).collect()
    assert abs(df[0]["b"] - df[0]["z"]) < 1e-12
    box = lambda *b: dict(zip(("x0", "y0", "x1", "y1"), map(float, b), strict=True))
    truth = spark.createDataFrame([("d", "a", "5,00", box(0, 0, 10, 10)), ("d", "b", "5,00", box(50, 50, 60, 60)), ("d", "c", "zz", box(0, 0, 1, 1))], f"doc_id string, key string, text string, bbox {BOX}")
    seen = spark.createDataFrame([("d", "5.00", box(0, 0, 10, 9))], f"doc_id string, text string, bbox {BOX}")
    rows = spark.createDataFrame([("d", "5.00 due")], "doc_id string, text string")
    assert {r["key"]: r["outcome"] for r in scoring.localised(truth, seen, rows).collect()} == {"a": "correct", "b": "mislocated", "c": "missed"}
    lat = scoring.latency(spark.createDataFrame([("x", 1), ("x", 2), ("y", 100), ("y", 101)], "arm string, ms bigint")).collect()[0]
    assert (lat["separable"], lat["gap"], lat["spread"], lat["faster"]) == (True, 99, 1, "x")


def test_risk_coverage_counts_fields_without_a_verdict(spark):
    truth = spark.createDataFrame([("d", "a", "5"), ("d", "b", "7"), ("e", "a", "9")], "doc_id string, key string, text string")
    seen = spark.createDataFrame([("d", "a", "integer", "5", "region", None, 0.6, None)], "doc_id string, key string, type string, value string, status string, source string, confidence double, arithmetic_ok boolean")
    got = {r["floor"]: r for r in scoring.risk_coverage(truth, seen, [0.5, 0.9]).collect()}
    assert {f: (r["fields"], r["admitted_right"], r["abstained_would_be_right"], r["abstained_would_be_wrong"]) for f, r in got.items()} == {0.5: (3, 1, 0, 2), 0.9: (3, 0, 1, 2)}
    assert abs(got[0.5]["coverage"] - 1 / 3) < 1e-9 and got[0.9]["coverage"] == 0
    assert {r["fields"] for r in scoring.risk_coverage(truth, seen.limit(0), [0.5]).collect()} == {3}


# Traces, certificates


def _certificate(genesis=trace.GENESIS):
    import hashlib

    from ledgerloom.functions.hashing import canonical

    head, records = hashlib.sha256(genesis.encode()).hexdigest(), []
    for stage in ("route", "bind", "gate"):
        r = {"stage": stage, "action": "ran", "reads": ["a"], "writes": "b", "digest": "0" * 64}
        head = hashlib.sha256((head + canonical(r)).encode()).hexdigest()
        records.append(r | {"head": head})
    field = lambda key, minor: {"key": key, "type": "amount", "page": 1, "bbox": [1, 1, 5, 5], "confidence": 0.9, "width": "region", "checks": {}, "minor": minor, "currency": "EUR"}
    return {
        "version": "1", "producedAt": "now", "declared": ["subtotal", "tax", "total", "date"], "document": {"digest": "d" * 64, "path": "x", "route": "text", "page": 1, "width": 100.0, "height": 100.0},
        "verdict": {"decision": "matched", "checks": [], "variance": None, "record": None}, "fields": {"subtotal": field("subtotal", "43290"), "tax": field("tax", "9091"), "total": field("total", "52381")},
        "abstentions": [{"key": "date", "check": "absent", "reason": "r", "type": "date", "page": 1, "bbox": None, "confidence": None, "text": None, "declined": {"value": None}}],
        "attestations": [], "trace": {"root": head, "records": records}, "replay": {"model": "m", "quantisation": "Q4", "sdkVersion": "1.0", "seed": 4242, "inputDigest": "i"},
    }


def test_certificates(spark):
    key = signing.new_key(spark)
    signed = signing.sign(spark, _certificate(), key)
    assert signing.signature_holds(spark, json.dumps(signed)) and not signing.signature_holds(spark, json.dumps(signed | {"version": "2"}))
    cases = {"clean": signed} | {name: certificates.tampered(signed, name) for name in certificates.TAMPERS}
    rows = [(k, json.dumps(v)) for k, v in cases.items()]
    df = spark.createDataFrame(rows, "id string, certificate string")
    holds = {k: signing.signature_holds(spark, t) for k, t in rows}
    signed_ok = F.element_at(F.create_map(*[F.lit(x) for kv in holds.items() for x in kv]), F.col("id"))
    steps = {(r["id"], r["step"]): r["outcome"] for r in certificates.verified(df, signed=signed_ok).collect()}
    assert {s: steps["clean", s] for s in certificates.STEPS} == {
        "signature": "pass", "provenance": "not checked", "attestations": "not applicable", "arithmetic": "pass", "trace": "pass", "sections": "pass", "descriptor": "pass", "replay": "not checked",
    }
    for name, step in certificates.TAMPERS.items():
        assert steps[name, step] == "fail", name
        assert steps[name, "signature"] == "fail", name
    digests = spark.createDataFrame([("clean", "d" * 64), ("a moved region", "e" * 64)], "id string, digest string")
    found = {r["id"]: r["outcome"] for r in certificates.verified(df, digests).filter("step = 'provenance'").collect()}
    assert found["clean"] == "pass" and found["a moved region"] == "fail" and found["an altered seed"] == "not checked"
    with pytest.raises(ValueError):
        certificates.tampered(certificates.tampered(signed, "an abstention removed"), "an abstention removed")


def test_validate_certificates(spark):
    bad = _certificate()
    bad["fields"]["date"] = {"key": "date", "type": "date", "value": "x", "bbox": None}
    bad["fields"]["total"]["bbox"] = [0, 0, 500, 5]
    bad["fields"]["tax"]["minor"] = "9.1"
    bad["declared"] += ["lost"]
    bad["trace"]["root"] = "short"
    del bad["replay"]["seed"]
    short = {k: v for k, v in _certificate().items() if k != "trace"}
    df = spark.createDataFrame([("good", json.dumps(_certificate())), ("bad", json.dumps(bad)), ("short", json.dumps(short))], "id string, certificate string")
    got = {r["id"]: r for r in certificates.validated(df).collect()}
    assert got["good"]["ok"] and got["short"]["problems"] == ['the certificate has no "trace" section']
    assert len(got["bad"]["problems"]) == 7


def test_replay(spark):
    a, b = _certificate(), _certificate()
    b |= {"producedAt": "later"}
    b["fields"]["tax"]["minor"] = "9092"
    b["declared"] = b["declared"][:-1]
    frame = lambda x: spark.createDataFrame([("c", json.dumps(x))], "id string, certificate string")
    diff = certificates.differences(frame(a), frame(b)).cache()
    assert sorted((r["path"], r["recorded"], r["regenerated"]) for r in diff.collect()) == [("declared[3]", '"date"', None), ("fields.tax.minor", '"9091"', '"9092"')]
    assert certificates.first_differences(diff).collect()[0]["path"] == "declared[3]"
    assert certificates.comparability(frame(a), "1.0", "m").collect()[0]["comparable"]
    other = certificates.comparability(frame(a), "2.0", "n").collect()[0]
    assert not other["comparable"] and other["reason"].count("; ") == 1


def test_built_certificate_is_valid(spark):
    verdict = "struct<admitted:boolean,check:string,confidence_check:string,binding:string,arithmetic:string>"
    field = f"array<struct<key:string,type:string,value:string,bbox:{BOX},confidence:double,text:string,source:string,reason:string,verdict:{verdict}>>"
    schema = f"""doc_id string, produced_at string, declared array<string>, document struct<digest:string,path:string,route:string,page:int,width:double,height:double>, fields {field}, currency string, decision string,
    checks {certificates.CHECKS}, variance struct<minor:string,proportion:double>, record struct<reference:string,currency:string,minor:string>,
    trace struct<root:string,records:array<struct<stage:string,action:string,reads:array<string>,writes:string,digest:string,head:string>>>, replay struct<model:string,quantisation:string,sdkVersion:string,seed:bigint,inputDigest:string>"""
    c = _certificate()
    rows = [(
        "d", "now", ["total", "date"], ("d" * 64, "p", "text", 1, 100.0, 100.0),
        [("total", "amount", "52381", (1.0, 1.0, 5.0, 5.0), 0.9, "523,81", None, None, (True, None, "passed", "region", "passed")), ("date", "date", None, None, None, None, None, "r", (False, "absent", None, None, None))],
        "EUR", "matched", [], None, None, (c["trace"]["root"], [(r["stage"], r["action"], r["reads"], r["writes"], r["digest"], r["head"]) for r in c["trace"]["records"]]), ("m", "Q4", "1.0", 4242, "i"),
    )]
    made = certificates.built(spark.createDataFrame(rows, schema)).withColumnRenamed("doc_id", "id").cache()
    parsed = json.loads(made.collect()[0]["certificate"])
    assert parsed["fields"]["total"]["minor"] == "52381" and parsed["abstentions"][0]["key"] == "date"
    assert certificates.validated(made).collect()[0]["problems"] == []
    steps = {r["step"]: r["outcome"] for r in certificates.verified(made).collect()}
    assert steps["trace"] == "pass" and steps["sections"] == "pass" and steps["arithmetic"] == "not checked"


def test_planner(spark):
    rows = [("r", 0, "doc.reference", "string", "PO-1", "document-asserted"), ("r", 1, "doc.total", "amount", "105", "document-asserted")]
    slots = spark.createDataFrame(rows, "run_id string, seq int, key string, type string, value string, provenance string")
    acts = planner.actions(spark)
    ready = planner.legal(slots, acts)
    assert [r["action"] for r in ready.collect()] == ["lookup_record"]
    assert planner.action_choices(ready).collect()[0]["choices"] == '{"enum":["lookup_record"]}'
    assert {(r["action"], r["param"]): r["choices"] for r in planner.reference_choices(slots, acts).collect()}["compute_variance", "documentAmount"] == ["doc.total"]
    assert planner.rendered(slots).collect()[0]["text"] == "doc.reference : string (document-asserted) = PO-1\ndoc.total : amount (document-asserted) = 1.05"
    ledger = spark.createDataFrame([("po1", 100, 1)], "reference_key string, amount_minor bigint, record_id bigint")
    assert planner.carried_out(slots, ledger).collect()[0]["variance"] == 5


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"ts": f"2026-05-18T10:{m:02d}:00.000Z", "platform": "x", "op": "ocr" if m % 2 else "completion", "model": "m", "gen_ms": m, "error": "e" if m % 5 == 0 else None} for m in range(40)]
    for k in range(4):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k * 10 : k * 10 + 10]))
    q = logs.by_window(logs.log_stream(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    from ledgerloom.schemas import INFERENCE_LOG

    batch = logs.by_window(spark.read.schema(INFERENCE_LOG).json(str(tmp_path)))
    key = lambda df: sorted((r["start"], r["op"], r["calls"], r["failures"], r["total_ms"]) for r in df.collect())
    assert key(spark.table("windows")) == key(batch) and batch.count() == 8


def test_run_from_regions_to_trace(spark):
    box = lambda x, y, w=40.0: (x, y, x + w, y + 10.0)
    page = [
        ("d", 0, "Subtotal", box(0.0, 0.0), 0.9, None), ("d", 1, "432,90", box(60.0, 0.0), 0.9, None), ("d", 2, "Tax", box(0.0, 20.0), 0.9, None), ("d", 3, "90,", box(60.0, 20.0, 14.0), 0.9, None), ("d", 4, "91", box(75.0, 20.0, 14.0), 0.8, None),
        ("d", 5, "Total due", box(0.0, 40.0), 0.9, None), ("d", 6, "523,81", box(60.0, 40.0), 0.7, None), ("t", 0, "523,99", box(0.0, 0.0), None, "text-layer"), ("t", 1, "432,90", box(0.0, 20.0), None, "text-layer"), ("t", 2, "90,91", box(0.0, 40.0), None, "text-layer"),
    ]
    regions = _regions(spark, page)
    raw = spark.createDataFrame([("d", {"subtotal": "432.90", "tax": "90,91", "total": "523,81", "vendor": "Nobody", "date": "bad"}), ("t", {"subtotal": "432,90", "tax": "90,91", "total": "523,99"})], "doc_id string, fields map<string,string>")
    routes = spark.createDataFrame([("d", "image"), ("t", "text")], "doc_id string, route string")
    template = spark.createDataFrame([r[:3] for r in INVOICE], "pos int, key string, type string")
    fields = run.judged_fields(raw, regions, routes, template).cache()
    got = {(r["doc_id"], r["key"]): (r["verdict"]["check"] or "admitted", r["reason"]) for r in fields.collect()}
    assert [got["d", k][0] for k in ("subtotal", "tax", "total", "vendor", "currency")] == ["admitted", "admitted", "admitted", "binding", "absent"] and ("d", "date") not in got
    assert got["t", "total"] == ("arithmetic", "the document does not agree with itself: subtotal + tax = total")
    records = run.trace_records(fields, routes).cache()
    assert {r["run_id"]: r["n"] for r in records.groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {"d": 6, "t": 6}
    from ledgerloom.functions.hashing import canonical

    assert all(canonical(json.loads(r["body"])) == r["body"] for r in records.collect())
    heads = trace.chained(records)
    assert heads.count() == 2 and all(len(r["heads"]) == 6 for r in heads.collect())


def test_model_answers(spark):
    df = spark.createDataFrame([('<think>x</think>```json\n{"total": "5"}\n```',), ("sorry, " + "x" * 300,)], "s string")
    got = df.select(text.parsed_json(F.col("s"), "total string").alias("j")).collect()
    assert got[0]["j"]["value"]["total"] == "5" and got[0]["j"]["error"] is None and got[1]["j"]["value"] is None and len(got[1]["j"]["error"]) == 130
    schema = ingest.answer_schema([r[:3] for r in INVOICE])
    assert schema["required"][0] == "vendor" and schema["properties"]["tax_rate"]["type"] == ["integer", "null"]
    with pytest.raises(ValueError):
        ingest.answer_schema([(0, "a", "float")])
    assert ingest.instruction(list(INVOICE)).splitlines()[-1] == "currency: Currency (string)"


def test_line_up_and_runs(spark):
    rows = [("m", 5, 10, 2.0, 1, 2), ("m", 5, 20, None, 2, 2), ("n", 1, 1, None, 0, 1)]
    got = {r["model"]: r for r in scoring.lineup(spark.createDataFrame(rows, "model string, bytes bigint, ms bigint, tok_per_sec double, correct int, total int")).collect()}
    assert got["m"]["ms"] == 30 and got["m"]["tok_per_sec"] == 2.0 and got["n"]["tok_per_sec"] is None
    amounts = spark.createDataFrame([("a", 100, 21, 121, 21, None), ("b", 100, 21, 150, None, 100)], "doc_id string, subtotal bigint, tax bigint, total bigint, tax_rate bigint, lines bigint")
    assert {r["name"]: (r["judged"], r["failed"]) for r in identities.runs(identities.checked(amounts)).collect()} == {identities.LINES: (1, 0), identities.TOTAL: (2, 1), identities.RATE: (1, 0)}


# Pages against plain versions


def plain_rows(page, least=layout.MIN_OVERLAP):
    """Rows of one page, region by region."""
    rows = []
    for r in sorted((r for r in page if r[3] is not None), key=lambda r: (r[3][1] + r[3][3]) / 2):
        fits = (row for row in rows if min(row[0][3][3] - row[0][3][1], r[3][3] - r[3][1]) > 0 and max(0, min(row[0][3][3], r[3][3]) - max(row[0][3][1], r[3][1])) / min(row[0][3][3] - row[0][3][1], r[3][3] - r[3][1]) >= least)
        home = next(fits, None)
        rows.append([r]) if home is None else home.append(r)
    return [sorted(row, key=lambda r: r[3][0]) for row in rows]


def random_pages(seed, pages=60):
    """Skewed lines with cells of several heights, ties, overlapping rows, flat boxes and regions without one."""
    rng = random.Random(seed)
    out = []
    for p in range(pages):
        skew, cells = rng.uniform(-0.06, 0.06), []
        for line in range(rng.choice([0, 1, 3, 12])):
            for col in range(rng.randrange(1, 6)):
                x, y, h = 100.0 * col + rng.choice([0, 5, 30]), 30.0 * line + skew * 100 * col, rng.choice([8.0, 10.0, 10.0, 24.0, 0.0])
                text = rng.choice(["12,", "40", "1.", "014,30", "Total", "x,  ", "7", None, "12,34", ""])
                cells.append((text, None if rng.random() < 0.1 else (x, y, x + rng.choice([20.0, 60.0, 96.0]), y + h), rng.choice([None, 0.5, 0.75]), rng.choice([None, "layer"])))
        rng.shuffle(cells)
        out += [(f"p{p}", i, *c) for i, c in enumerate(cells)]
    return [(d, i, t, b, c, s) for d, i, t, b, c, s in out]


@pytest.mark.parametrize("together", [1, 7, 50_000])
def test_rows_of_skewed_pages_equal_plain(spark, monkeypatch, together):
    monkeypatch.setattr(layout, "BATCH_REGIONS", together)
    monkeypatch.setattr(layout, "ANCHOR_ENTRIES", 40)
    page = random_pages(together)
    r = _regions(spark, page)
    by = {}
    for x in page:
        by.setdefault(x[0], []).append(x)
    want, order, texts, joined = {}, [], {}, []
    for d, xs in by.items():
        rows = plain_rows(xs)
        want |= {(d, x[1]): (i, j) for i, row in enumerate(rows) for j, x in enumerate(row)} | {(d, x[1]): (None, None) for x in xs if x[3] is None}
        reading = [x for row in rows for x in row] + [x for x in xs if x[3] is None]
        order += [(d, x[1], k) for k, x in enumerate(reading)]
        if rows:
            texts[d] = "\n".join("  ".join(x[2] for x in row if x[2] is not None) for row in rows)
        out = []
        for x in reading:
            a, b = out[-1][1] if out else None, x[3]
            tall = max(a[3] - a[1], b[3] - b[1]) if a and b else 0
            low = min(a[3] - a[1], b[3] - b[1]) if a and b else 0
            near = low > 0 and max(0, min(a[3], b[3]) - max(a[1], b[1])) / low > 0.5 and (b[0] - a[2]) / tall < 0.6
            if near and re.search(r"[.,]\s*$", out[-1][0] or "") and re.fullmatch(r"[0-9]{1,2}|[0-9]{3}([.,][0-9]{1,2})?", (x[2] or "").strip()):
                sure = min(1.0 if c is None else c for c in (out[-1][2], x[4]))
                out[-1] = (out[-1][0].strip() + x[2].strip(), (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])), sure, None)
            else:
                out.append((x[2], b, x[4], x[5]))
        joined += [(d, k, *x) for k, x in enumerate(out)]
    got = layout.reading_order(r).collect()
    assert {(x["doc_id"], x["idx"]): (x["row_id"], x["pos"]) for x in got} == want and sorted((x["doc_id"], x["idx"], x["place"]) for x in got) == sorted(order)
    assert {x["doc_id"]: x["text"] for x in layout.page_text(r).collect()} == texts
    assert sorted(((x["doc_id"], x["idx"], x["text"], x["bbox"] and tuple(x["bbox"]), x["confidence"], x["source"]) for x in layout.joined_numbers(r).collect()), key=repr) == sorted(joined, key=repr)
    assert sum(a[2] != b[2] for a, b in zip(sorted(joined), sorted((x[0], x[1], x[2]) for x in page))) > 0
    assert layout.page_text(r.limit(0)).count() == 0


def test_spans_by_index_equal_all_spans(spark):
    """The first run that carries a value, from all runs of each row and the value-by-value test."""
    rng = random.Random(12)
    tokens = ["2.831,", "40", "1", "234,50", "EUR", "$", "-5", "21%", "21", "%", "18", "May", "2026", "2026-05-18", "Total", "North", "wind", "north-wind", "007", "12,34", "", "  ", "10 5,00", "Due: 18", "May 2026", "USDT"]
    page = []
    for p in range(150):
        for line in range(2):
            for col in range(rng.randrange(1, 6)):
                text = rng.choice(tokens) + (rng.choice(["", " ", f" {rng.choice(tokens)}"]))
                page.append((f"p{p}", len(page), text, (100.0 * col, 50.0 * line, 100.0 * col + 90, 50.0 * line + 10), 0.5, None))
    kinds = {"amount": ["283140", "123450", "1234", "500", "-500", "700", "100050", "1200", "4000"], "integer": ["21", "5", "7", "40", "18"], "date": ["2026-05-18", "2026-05-19"], "string": ["North wind", "Total", "wind EUR", "May 2026", "Due", "40 1"]}
    values = [(f"p{p}", f"{k}{n}", k, v) for p in range(150) for k, vs in kinds.items() for n, v in enumerate(vs)]
    v = spark.createDataFrame(values, "doc_id string, key string, type string, value string")
    placed = layout.clustered(_regions(spark, page)).cache()
    hit = binding.exact(v, placed)
    rest = v.join(hit, ["doc_id", "key"], "left_anti")
    cells = binding.rows_of(placed).withColumn("s", F.explode(F.sequence(F.lit(1), F.size("cells")))).withColumn("e", F.explode(F.sequence(F.col("s"), F.size("cells"))))
    runs = cells.select("doc_id", "row_id", "s", "e", F.array_join(F.transform(F.slice("cells", F.col("s"), F.col("e") - F.col("s") + 1), lambda c: c["text"]), " ").alias("text"))
    both = rest.join(runs, "doc_id").filter(F.coalesce(values_of.region_key(F.col("type"), F.col("text")) == values_of.value_key(F.col("type"), F.col("value")), F.lit(False)) | values_of.carries(F.col("type"), F.col("text"), F.col("value")))
    want = {(r["doc_id"], r["key"]): (r["at"]["text"]) for r in both.groupBy("doc_id", "key").agg(F.min(F.struct("row_id", "s", "e", "text")).alias("at")).collect()}
    found = binding.spans(rest, placed)
    got = {(r["doc_id"], r["key"]): r["span"]["text"] for r in found.collect()}
    assert got == want and len({k[1] for k in got}) > 12
    plan = binding.span_index(binding.rows_of(placed), rest.select("doc_id", "type", values_of.value_key(F.col("type"), F.col("value")).alias("match_key")))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_growing_sides_are_not_broadcast(spark):
    """places are found by shuffled joins, as the driver can't hold either side; F3, F8, F9: pages are dealt to all tasks before they are read."""
    from ledgerloom.queries import QUERIES

    plan = QUERIES["localised_fields"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert "REPARTITION_BY_NUM" in plan


def test_signatures_cost_few_sums(spark, monkeypatch):
    """a signature is made and verified by stored multiples, not bit by bit; wrong ones still fail."""
    seed, sums, plain = b"another seed of thirty-two bytes", [], signing._sum
    public, _ = signing.signature_of(seed, b"first")
    assert signing.verified(*[public, b"first", signing.signature_of(seed, b"first")[1]])
    monkeypatch.setattr(signing, "_sum", lambda p, q: sums.append(1) or plain(p, q))
    key, sig = signing.signature_of(seed, b"message")
    assert key == public and signing.verified(public, b"message", sig)
    assert len(sums) < 300
    assert not signing.verified(public, b"massage", sig)
    assert not signing.verified(public, b"message", sig[:32] + bytes(32))


def test_values_are_bound_on_their_page(spark):
    """a page is one row, so that nothing but the dealt orders is shuffled or written."""
    from ledgerloom.queries import QUERIES

    plan = QUERIES["bound_values"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan and "MapInArrow" not in plan
    assert plan.count("[0-9,]*,[0-9]{3})$") == 2  # amounts are read as regions and as runs, each written out once


def test_exact_places_equal_all_pairs(spark):
    """Regions whose digits cannot give a value are not read; none that carries one is lost."""
    rng = random.Random(3)
    texts = ["12 EUR 34", "1234", "12,34", "0,05", "0.00", "5", "007", "7 %", "-5", "$ 1,000", "1000.0", "1.000,5", "18 May 2026", "2026-05-18", " 2026-05-18 ", "May 18", "Nord", "n-ord", "", None, "R$12", "-", "123456789012345678901,00", "1 2", "USD 1 USD 2", "1e3", " 5,00", "--", "0"]
    page = [(f"p{p}", i, rng.choice(texts), rng.choice([(0.0, 10.0 * i, 5.0, 10.0 * i + 9)] * 9 + [None]), 0.5, None) for p in range(120) for i in range(rng.randrange(0, 8))]
    kinds = {"amount": ["1234", "123400", "5", "500", "-500", "0", "100000", "100050", "1200", "12345678901234567890100"], "integer": ["5", "7", "1234", "-5", "0"], "date": ["2026-05-18", "2026"], "string": ["Nord", "n ord", "--", "1234"], "odd": ["5"]}
    v = spark.createDataFrame([(f"p{p}", f"{k}{n}", k, x) for p in range(120) for k, xs in kinds.items() for n, x in enumerate(xs)], "doc_id string, key string, type string, value string")
    placed = layout.clustered(_regions(spark, page)).filter("row_id is not null").cache()
    both = v.join(placed, "doc_id").filter(values_of.region_key(F.col("type"), F.col("text")) == values_of.value_key(F.col("type"), F.col("value")))
    want = {(r["doc_id"], r["key"]): (r["at"]["text"], r["n"]) for r in both.groupBy("doc_id", "key").agg(F.min(F.struct("idx", "text")).alias("at"), F.count("*").alias("n")).collect()}
    got = {(r["doc_id"], r["key"]): (r["region"]["text"], r["matches"]) for r in binding.exact(v, _regions(spark, page)).collect()}
    assert got == want and len({k[1] for k in got}) > 14
    names = ["a", "b"]  # values keep what else they have; a document without regions, and one without a number
    other = binding.bound(spark.createDataFrame([("x", "k", "string", "v", names), (None, "k", "string", "v", names)], "doc_id string, key string, type string, value string, more array<string>"), _regions(spark, page)).collect()
    assert [(r["status"], r["reason"], r["more"], r["bbox"]) for r in other] == [("unbound", binding.NO_REGIONS, names, None)] * 2


def test_runs_are_judged_on_their_page(spark):
    """regions, values, identities and verdicts of a document are one row; only the dealt orders are shuffled, and nothing is made before."""
    from ledgerloom.queries import QUERIES

    plan = QUERIES["run_fields"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan and "MapInArrow" not in plan
    assert "regexp" not in plan[plan.index("Exchange") :]


def test_judged_documents_that_lack_something(spark):
    """No route, no regions, no value that could be read, another's page; line items against the subtotal."""
    page = [("a", 0, "10,00", (0.0, 0.0, 5.0, 5.0), 0.9, None), ("b", 1, "00", (5.0, 0.0, 9.0, 5.0), 0.9, None), ("b", 0, "10,", (0.0, 0.0, 4.0, 5.0), 0.8, None), ("z", 0, "10,00", (0.0, 0.0, 5.0, 5.0), 0.9, None)]
    raw = spark.createDataFrame([("a", {"subtotal": "10,00"}), ("b", {"subtotal": "10.00", "other": "x"}), ("c", {"subtotal": " "}), ("d", {"subtotal": "bad"}), ("e", None), ("f", {"subtotal": "10,00"})], "doc_id string, fields map<string,string>")
    routes = spark.createDataFrame([("b", "image"), ("c", "text"), ("d", "image"), ("f", "image")], "doc_id string, route string")
    lines = spark.createDataFrame([("b", 1001), ("f", 5)], "doc_id string, lines bigint")
    template = spark.createDataFrame([(0, "subtotal", "amount")], "pos int, key string, type string")
    judge = lambda lines: {r["doc_id"]: (r["status"], r["text"], r["confidence"], r["verdict"]["check"], r["verdict"]["arithmetic"], r["reason"]) for r in run.judged_fields(raw, _regions(spark, page), routes, template, lines=lines).collect()}
    none = ("unbound", None, None)
    want = {"a": (*none, "binding", None, binding.NO_REGIONS), "b": ("region", "10,00", 0.8, None, "passed", None), "c": (*none, "absent", None, "the model reported no value for this field"), "f": (*none, "binding", None, binding.NO_REGIONS)}
    want["e"] = want["c"]
    assert judge(lines) == want
    assert judge(None) == want | {"b": ("region", "10,00", 0.8, None, "not checked", None)}
