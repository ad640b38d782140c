"""Certificates: built from judged documents, validated, verified step by step, compared on replay.

A certificate is one JSON text for each document. Its digest is over the canonical text, so the raw text is kept and structs
are parsed from it with the schema below; presence of a key is asked of the raw text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, inside_page
from ..functions.hashing import canonical, canonical_json, digest, read
from ..functions.numbers import exact, truncated_quotient, within_tolerance
from .trace import GENESIS

VERSION = "1"
# Sections, routes and descriptor keys of a certificate.
SECTIONS = ("version", "document", "declared", "verdict", "fields", "abstentions", "attestations", "trace", "replay")
ROUTES = ("text", "image", "pdf-needs-render")
DESCRIPTOR = ("model", "quantisation", "sdkVersion", "seed", "inputDigest")
STEPS = ("signature", "provenance", "attestations", "arithmetic", "trace", "sections", "descriptor", "replay")
VOLATILE = ("producedAt", "document.path", "signature")

CHECKS = "array<struct<name:string,outcome:string,detail:string>>"
SCHEMA = {
    "version": "string", "producedAt": "string", "declared": "array<string>",
    "document": "struct<digest:string,path:string,route:string,page:int,width:double,height:double>",
    "verdict": f"struct<decision:string,checks:{CHECKS},variance:struct<minor:string,proportion:double>,record:struct<reference:string,currency:string,minor:string>>",
    "fields": "map<string,struct<key:string,type:string,page:int,bbox:array<double>,confidence:double,unbound:boolean,width:string,source:string,minor:string,currency:string,value:string>>",
    "abstentions": "array<struct<key:string,check:string,reason:string,type:string,page:int,bbox:array<double>,confidence:double,text:string,declined:string>>",
    "attestations": "array<string>",
    "trace": "struct<root:string,records:array<struct<stage:string,action:string,reads:array<string>,writes:string,digest:string,head:string>>>",
    "replay": "struct<model:string,quantisation:string,sdkVersion:string,seed:string,inputDigest:string>",
    "signature": "struct<alg:string,publicKey:string,sig:string,digest:string>",
}
# What the steps read of a certificate; its trace is followed in Python.
STEP_PARTS = ("version", "declared", "document", "fields", "abstentions", "attestations", "replay", "signature")


def built(documents: DataFrame) -> DataFrame:
    """(doc_id, certificate JSON text) from one row for each document.

    documents: (doc_id, declared, document, fields array of judged fields, currency, decision, checks, variance, record, trace, replay,
    produced_at). A document without a trace root is an error.
    """
    c = F.col
    page = c("document.page")
    amount = lambda f: f["type"] == "amount"
    text = lambda x: x.cast("string")
    checks = lambda f: F.struct(f["verdict"]["confidence_check"].alias("confidence"), f["verdict"]["binding"].alias("binding"), f["verdict"]["arithmetic"].alias("arithmetic"))
    box = lambda f: F.when(f["bbox"].isNotNull(), F.array(f["bbox"]["x0"], f["bbox"]["y0"], f["bbox"]["x1"], f["bbox"]["y1"]))

    def admitted(f):
        return F.struct(
            f["key"].alias("key"), f["type"].alias("type"), page.alias("page"), box(f).alias("bbox"), f["confidence"].alias("confidence"), f["verdict"]["binding"].alias("width"), checks(f).alias("checks"),
            f["source"].alias("source"), F.when(amount(f), text(f["value"])).alias("minor"), F.when(amount(f), c("currency")).alias("currency"), F.when(~amount(f), f["value"]).alias("value"),
        )

    def refused(f):
        declined = F.struct(F.when(amount(f), text(f["value"])).alias("minor"), F.when(amount(f), c("currency")).alias("currency"), F.when(~amount(f), f["value"]).alias("value"))
        return F.struct(
            f["key"].alias("key"), f["verdict"]["check"].alias("check"), f["reason"].alias("reason"), f["type"].alias("type"), page.alias("page"), box(f).alias("bbox"),
            f["confidence"].alias("confidence"), f["text"].alias("text"), declined.alias("declined"),
        )

    good = F.filter("fields", lambda f: f["verdict"]["admitted"])
    bad = F.filter("fields", lambda f: ~f["verdict"]["admitted"])
    root = F.when(c("trace.root").isNull(), F.raise_error(F.lit("the run carries no trace"))).otherwise(c("trace"))
    whole = F.struct(
        F.lit(VERSION).alias("version"), c("produced_at").alias("producedAt"), "declared", "document",
        F.struct("decision", "checks", "variance", "record").alias("verdict"),
        F.map_from_entries(F.transform(good, lambda f: F.struct(f["key"], admitted(f)))).alias("fields"),
        F.transform(bad, refused).alias("abstentions"),
        F.array().cast("array<string>").alias("attestations"), root.alias("trace"), "replay",
    )
    return documents.select("doc_id", F.to_json(whole, {"ignoreNullFields": "true"}).alias("certificate"))


def certificate_digest(text: Column) -> Column:
    """Digest of the canonical text without its signature."""
    return digest(canonical_json(text, ("signature",)))


def _struct(text: Column, schema: str) -> Column:
    """A JSON text as a struct; exploded, so that it is parsed once: as a plain column the optimizer parses it again for each field that is read."""
    return F.explode_outer(F.array(F.from_json(text, schema)))


def parsed(certificates: DataFrame, parts: tuple[str, ...] = tuple(SCHEMA)) -> DataFrame:
    """(id, certificate) with ``c``, the struct of these parts, and ``keys``, the sections there are."""
    return certificates.withColumn("c", _struct(F.col("certificate"), ", ".join(f"{k} {SCHEMA[k]}" for k in parts))).withColumn("keys", F.coalesce(F.json_object_keys("certificate"), F.array().cast("array<string>")))


def _each(items: Column, rules) -> Column:
    """Messages of rules (condition, text) over an array."""
    return F.flatten(F.transform(items, lambda x: F.array_compact(F.array(*[F.when(bad, message) for bad, message in rules(x)]))))


def _joined(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _set_rules() -> dict[str, Column]:
    """Keys that are both admitted and refused; declared and neither; neither declared nor expected (only where something is declared)."""
    fields = F.map_keys("c.fields")
    refused = F.array_distinct(F.transform("c.abstentions", lambda a: a["key"]))
    declared, accounted = F.array_distinct(F.coalesce("c.declared", F.array().cast("array<string>"))), F.array_union(fields, refused)
    extra = F.when(F.size(declared) > 0, F.array_except(accounted, declared)).otherwise(F.array().cast("array<string>"))
    return {"in_both": F.array_intersect(fields, refused), "unaccounted": F.array_except(declared, accounted), "undeclared": extra}


def set_problems(parsed: DataFrame) -> DataFrame:
    """parsed: (id, c struct with fields, abstentions, declared). (id, in_both, unaccounted, undeclared): the keys that break each rule."""
    return parsed.select("id", *[keys.alias(name) for name, keys in _set_rules().items()])


def _common_problems() -> Column:
    """Disjoint sections, and what was declared against what is accounted for."""
    rules = _set_rules()
    said = {"in_both": '" appears in both fields and abstentions', "unaccounted": '" was declared and is neither admitted nor abstained', "undeclared": '" appears in the certificate and was never declared'}
    about = lambda keys, text: F.transform(keys, lambda key: _joined('"', key, text))
    return F.concat(*[about(rules[k], text) for k, text in said.items()])


def _plain(x: Column) -> Column:
    """A coordinate without the fraction that is none."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _unplaced(e) -> Column:
    return e["value"]["bbox"].isNull() & ~F.coalesce(e["value"]["unbound"], F.lit(False))


def validated(certificates: DataFrame) -> DataFrame:
    """certificates: (id, certificate). (id, ok, problems): what is wrong with each, by the producer's rules."""
    p = parsed(certificates)
    c = F.col
    missing = F.transform(F.array_except(F.array(*map(F.lit, SECTIONS)), "keys"), lambda s: _joined('the certificate has no "', s, '" section'))
    version = F.when(~c("c.version").eqNullSafe(F.lit(VERSION)), F.array(_joined('version is "', F.coalesce("c.version", F.lit("undefined")), f'", and this checker reads {VERSION}')))
    first = F.concat(F.coalesce(version, F.array().cast("array<string>")), missing)
    w, h = c("c.document.width"), c("c.document.height")

    def field_rules(e):
        f, b = e["value"], e["value"]["bbox"]
        amount = f["type"] == "amount"
        off = ~inside_page(box(*(b[k] for k in range(4))), w, h)
        return (
            (amount & ~F.coalesce(f["minor"].rlike("^-?[0-9]+$"), F.lit(False)), _joined("fields.", e["key"], ".minor is not minor units as decimal digits")),
            (_unplaced(e), _joined("fields.", e["key"], " was admitted with no region and is not marked unbound")),
            (b.isNotNull() & w.isNotNull() & h.isNotNull() & off, _joined("fields.", e["key"], " has a region [", F.array_join(F.transform(b, _plain), ", "), "] that is not inside the ", _plain(w), " by ", _plain(h), " page")),
        )

    refusals = _each(c("c.abstentions"), lambda a: (
        (a["check"].isNull() | (a["check"] == ""), _joined('abstentions["', a["key"], '"] names no check that refused it')),
        (a["declined"].isNull(), _joined('abstentions["', a["key"], '"] carries no declined value, so it cannot be scored')),
    ))
    descriptor = F.array_compact(F.array(*[F.when(c(f"c.replay.{k}").isNull(), F.lit(f"replay.{k} is missing, so the descriptor is not sufficient to reproduce the run")) for k in DESCRIPTOR]))
    route = F.when(~F.coalesce(c("c.document.route").isin(*ROUTES), F.lit(False)), F.array(_joined('document.route is "', F.coalesce("c.document.route", F.lit("undefined")), f'", which is not a route this reader produces ({", ".join(ROUTES)})')))
    root = F.when(~F.coalesce(c("c.trace.root").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.array(F.lit("trace.root is not a sha-256 digest")))
    none = F.array().cast("array<string>")
    rest = F.concat(_common_problems(), _each(F.map_entries("c.fields"), field_rules), refusals, descriptor, F.coalesce(route, none), F.coalesce(root, none))
    problems = F.when(F.size(first) > 0, first).otherwise(rest)
    return p.select("id", (F.size(problems) == 0).alias("ok"), problems.alias("problems"))


def _sections(p: DataFrame) -> Column:
    c = F.col
    version = F.when(~c("c.version").eqNullSafe(F.lit(VERSION)), F.array(F.lit("version")))
    fields = _each(F.map_entries("c.fields"), lambda e: (
        (_unplaced(e), _joined('"', e["key"], '" was admitted with no region and is not marked unbound')),
        ((e["value"]["type"] == "amount") & e["value"]["minor"].isNull(), _joined('"', e["key"], '" carries no amount')),
    ))
    refused = _each(c("c.abstentions"), lambda a: ((a["check"].isNull() | (a["check"] == ""), F.lit("an abstention names no check")), (a["declined"].isNull(), F.lit("an abstention carries no declined value"))))
    return F.size(F.concat(F.coalesce(version, F.array().cast("array<string>")), _common_problems(), fields, refused)) == 0


def _arithmetic() -> Column:
    of = lambda k: exact(F.try_element_at("c.fields", F.lit(k))["minor"])
    s, t, total = of("subtotal"), of("tax"), of("total")
    rate = F.try_element_at("c.fields", F.lit("tax_rate"))["value"].try_cast("bigint")
    one = within_tolerance(s + t - total)
    two = within_tolerance(t - truncated_quotient(s * rate * 100, F.lit(10000)))
    return F.when(one.isNull() & two.isNull(), "not checked").when(F.coalesce(one, F.lit(True)) & F.coalesce(two, F.lit(True)), "pass").otherwise("fail")


def _trace_ok(text: Column, genesis: str) -> Column:
    """Whether the records chain from the genesis to the root; their canonical texts need Python."""
    start = hashlib.sha256(genesis.encode()).hexdigest()

    def follow(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                value, written = read(t)
                trace, head, ok = value["trace"], start, True
                for r in trace["records"]:
                    head = hashlib.sha256((head + written({k: v for k, v in r.items() if k != "head"})).encode()).hexdigest()
                    ok = ok and head == r.get("head")
                out.append(ok and head == trace["root"])
            except (ValueError, TypeError, KeyError, AttributeError):
                out.append(False)
        return pa.array(out, pa.bool_())

    return F.arrow_udf(follow, "boolean")(text)


def verified(certificates: DataFrame, digests: DataFrame | None = None, genesis: str = GENESIS, signed: Column | None = None) -> DataFrame:
    """certificates: (id, certificate); digests: (id, digest) of the documents at hand. (id, step, outcome), a row for each step.

    signed: whether the signature verifies (see ``signing.holds``); without it, or where it is null, a signature whose digest is right is ``not checked``.
    """
    p = parsed(certificates, STEP_PARTS)
    c = F.col
    right = certificate_digest(F.when(c("c.signature.alg") == "ed25519", c("certificate"))) == c("c.signature.digest")  # tasks' Python sees null elsewhere
    checked = F.lit("not checked") if signed is None else F.when(signed.isNull(), "not checked").when(signed, "pass").otherwise("fail")
    signature = F.when(c("c.signature").isNull() | ~c("c.signature.alg").eqNullSafe(F.lit("ed25519")) | ~F.coalesce(right, F.lit(False)), "fail").otherwise(checked)
    outcome = {
        "signature": signature,
        "provenance": F.when(c("_own").isNull(), "not checked").when(c("_own").eqNullSafe(c("_said")), "pass").otherwise("fail"),
        "attestations": F.when(F.size(F.coalesce("c.attestations", F.array().cast("array<string>"))) > 0, "fail").otherwise("not applicable"),
        "arithmetic": _arithmetic(),
        "trace": F.when(_trace_ok(c("certificate"), genesis), "pass").otherwise("fail"),
        "sections": F.when(_sections(p), "pass").otherwise("fail"),
        "descriptor": F.when(F.forall(F.array(*[c(f"c.replay.{k}").isNotNull() for k in DESCRIPTOR]), lambda x: x), "pass").otherwise("fail"),
        "replay": F.lit("not checked"),
    }
    own = outcome.pop("provenance")
    steps = p.select("id", c("c.document.digest").alias("_said"), *[o.alias(k) for k, o in outcome.items()])  # joined by outcomes, not by whole certificates
    steps = steps.withColumn("_own", F.lit(None).cast("string")) if digests is None else steps.join(digests.select("id", F.col("digest").alias("_own")).hint("merge"), "id", "left")
    steps = steps.withColumn("provenance", own)
    rows = F.array(*[F.struct(F.lit(k).alias("step"), F.col(k).alias("outcome")) for k in STEPS])
    return steps.select("id", F.inline(rows))


def _not_comparable(sdk_version: str, model: str) -> Column:
    """Why a replay of ``c`` under this SDK and model may not be compared; empty if it may."""
    sdk, m = F.col("c.replay.sdkVersion"), F.col("c.replay.model")
    return F.concat_ws(
        "; ",
        F.when(~sdk.eqNullSafe(F.lit(sdk_version)), _joined("the certificate was produced on SDK ", F.coalesce(sdk, F.lit("undefined")), f" and this is SDK {sdk_version}")),
        F.when(~m.eqNullSafe(F.lit(model)), _joined("the certificate names ", F.coalesce(m, F.lit("undefined")), f" and this run has {model}")),
    )


def comparability(certificates: DataFrame, sdk_version: str, model: str) -> DataFrame:
    """(id, comparable, reason): whether a replay under this SDK and model may be compared at all."""
    why = _not_comparable(sdk_version, model)
    able = _joined(F.col("c.replay.model"), " on SDK ", F.col("c.replay.sdkVersion"))
    return parsed(certificates).select("id", (why == "").alias("comparable"), F.when(why == "", able).otherwise(why).alias("reason"))


def _inside(value: dict | list, path: str) -> dict:
    """What a JSON object or array holds, by path."""
    return {f"{path}.{k}" if path else k: v for k, v in value.items()} if isinstance(value, dict) else {f"{path}[{i}]": v for i, v in enumerate(value)}


def _walk(value, path: str = "") -> Iterator[tuple[str, str]]:
    """Every scalar (and empty container) with its path; the value as JSON."""
    if isinstance(value, dict | list) and value:
        for at, v in _inside(value, path).items():
            yield from _walk(v, at)
    else:
        yield path, canonical(value)


def leaves(certificates: DataFrame) -> DataFrame:
    """(id, path, value): every scalar (and empty container) of a JSON text with its path; the value as JSON."""

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *leaf) for i, t in zip(batch.column("id").to_pylist(), batch.column("certificate").to_pylist(), strict=True) for leaf in _walk(json.loads(t))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows, strict=True) if rows else ([], [], []))], ["id", "path", "value"])

    return certificates.select(F.col("id").cast("string").alias("id"), "certificate").mapInArrow(flatten, "id string, path string, value string")


def _apart(a, b, path: str, known: frozenset[str], booleans: bool = True) -> Iterator[tuple[str, int, str]]:
    """(path, 0 for a or 1 for b, leaf) where two JSON values may differ, without what lies under the known paths; equal values give no leaves.

    Python takes true for 1, so values that may hold booleans are equal only if they print alike, too.
    """
    if path in known or (a == b and not (booleans and repr(a) != repr(b))):
        return
    if type(a) is type(b) and isinstance(a, dict | list) and a and b:
        x, y = _inside(a, path), _inside(b, path)
        for at, v in x.items():
            if at in y:
                yield from _apart(v, y[at], at, known, booleans)
        alone = ((0, x, y), (1, y, x))
    else:
        alone = ((0, {path: a}, {}), (1, {path: b}, {}))
    for side, its, others in alone:
        for at, v in its.items():
            if at not in others:
                yield from ((p, side, leaf) for p, leaf in _walk(v, at))


APART = "array<struct<path:string,recorded:string,regenerated:string>>"


def _differing(recorded: Column, regenerated: Column, volatile: tuple[str, ...]) -> Column:
    """APART of two certificates: the leaves that differ outside the volatile paths, in order of their paths; a null certificate has no leaves.

    A pair is walked side by side in one task, so that only what differs becomes rows; canonical values need Python.
    """
    known, under = frozenset(volatile), tuple(v + end for v in volatile for end in ".[")

    def of(a: str | None, b: str | None) -> list[dict]:
        texts = [t for t in (a, b) if t is not None]
        if len(texts) == 2:
            found = _apart(*map(json.loads, texts), "", known, any(word in t for t in texts for word in ("true", "false")))
        else:
            found = ((p, int(a is None), leaf) for t in texts for p, leaf in _walk(json.loads(t)))
        leaves: dict[str, list] = {}
        for path, side, leaf in found:  # a path may be met from either side on its own
            if path not in known and not path.startswith(under):
                leaves.setdefault(path, [None, None])[side] = leaf
        return [{"path": p, "recorded": x, "regenerated": y} for p, (x, y) in sorted(leaves.items()) if x != y]

    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(k, pa.string()) for k in ("path", "recorded", "regenerated")]))
        return pa.array([of(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    return F.arrow_udf(compare, APART)(recorded, regenerated)


def differences(recorded: DataFrame, regenerated: DataFrame, volatile: tuple[str, ...] = VOLATILE) -> DataFrame:
    """(id, path, recorded, regenerated) where two certificates differ outside the volatile paths."""
    side = lambda rows, name: rows.select(F.col("id").cast("string").alias("id"), F.col("certificate").alias(name))
    pairs = side(recorded, "a").join(side(regenerated, "b"), "id", "full_outer")
    return pairs.select("id", _differing(F.col("a"), F.col("b"), volatile).alias("apart")).select("id", F.inline("apart"))


def first_differences(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("differences"))


def replayed(recorded: DataFrame, files: DataFrame, regenerated: DataFrame, sdk_version: str, model: str) -> DataFrame:
    """(id, outcome, detail) of replaying each certificate: ``not comparable``, ``input missing``, ``match`` or ``mismatch``, asked in this order.

    recorded, regenerated: (id, certificate), made by the same construction; files: (digest) of the documents at hand.
    The verdict is the recorded one in both, as the records it was reached against are not in a certificate.
    """
    c = F.col
    asked = recorded.select("id", "certificate", _struct(c("certificate"), "document struct<digest:string>, replay struct<model:string,sdkVersion:string>").alias("c"))
    asked = asked.select("id", "certificate", c("c.document.digest").alias("digest"), _not_comparable(sdk_version, model).alias("why"))
    asked = asked.join(files.select("digest").distinct().withColumn("there", F.lit(True)), "digest", "left")
    # certificates meet once, whole; their texts come out of expressions that look small to the planner, whose broadcast the driver could not hold
    both = asked.join(regenerated.select("id", c("certificate").alias("again")).hint("merge"), "id", "left")
    ready = (c("why") == "") & c("there").isNotNull()
    both = both.withColumn("apart", _differing(F.when(ready, c("certificate")), F.when(ready, c("again")), (*VOLATILE, "verdict")))
    both = both.withColumn("n", F.size("apart")).withColumn("first", F.get("apart", F.lit(0)))
    out = both.select("*", _struct(F.when(ready & (c("n") == 0), c("again")), "fields map<string,string>, trace struct<root:string>").alias("made"))
    outcome = F.when(c("why") != "", "not comparable").when(c("there").isNull(), "input missing").when(c("n") > 0, "mismatch").otherwise("match")
    shown = lambda side: F.coalesce(c("first")[side], F.lit("undefined"))
    detail = (
        F.when(c("why") != "", c("why")).when(c("there").isNull(), _joined("no file digests to ", F.left("digest", F.lit(12))))
        .when(c("n") > 0, _joined(c("n").cast("string"), " differences, first at ", c("first.path"), ": ", shown("recorded"), " against ", shown("regenerated")))
        .otherwise(_joined(F.size("made.fields").cast("string"), " fields, root ", F.left("made.trace.root", F.lit(12))))
    )
    return out.select("id", outcome.alias("outcome"), detail.alias("detail"))


# Named mutations and the step that must catch each.
TAMPERS = {
    "an altered total": "arithmetic",
    "an abstention removed": "sections",
    "a trace record reordered": "trace",
    "an altered confidence": "signature",
    "a moved region": "signature",
    "an altered seed": "signature",
    "the signature removed": "signature",
}


def tampered(certificate: dict, name: str) -> dict:
    """A mutated copy of one certificate; a mutation that changes nothing is an error."""
    out = json.loads(json.dumps(certificate))
    match name:
        case "an altered total":
            out["fields"]["total"]["minor"] = "62381"
        case "an abstention removed":
            out["abstentions"] = []
        case "a trace record reordered":
            out["trace"]["records"].reverse()
        case "an altered confidence":
            out["fields"]["tax"]["confidence"] = 0.99
        case "a moved region":
            out["fields"]["total"]["bbox"] = [0, 0, 10, 10]
        case "an altered seed":
            out["replay"]["seed"] = 1
        case "the signature removed":
            out.pop("signature", None)
    if out == certificate:
        raise ValueError(f"{name} changes nothing")
    return out
