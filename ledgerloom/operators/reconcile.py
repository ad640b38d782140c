"""A document against its candidate records: ordered three-valued checks and a four-valued decision.

docs carries for ``currency`` and ``total`` a state - ``have``, ``withheld`` or ``missing`` - with the check that withheld it:
(doc_id, seen, currency, currency_state, currency_by, total, total_state, total_by).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact, within_tolerance
from ..functions.text import loose

# Decisions and outcomes.
DECISIONS = ("matched", "mismatch", "indeterminate", "no-candidate")


def _check(name: str, outcome: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), outcome.alias("outcome"), detail.alias("detail"))


def _text(*parts) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])


def state_of(key: Column, admitted: Column) -> Column:
    """missing, withheld or have, for a field that may not be there at all."""
    return F.when(key.isNull(), "missing").when(~admitted, "withheld").otherwise("have")


def raw_state(fields: Column, key: str) -> Column:
    """struct<state, value, by> of a field in a raw JSON object of judged fields: missing if the key is not there, withheld if it is there but null or
    not admitted (``by`` is the check that refused it), else have. A variant tells null from missing, which a struct does not."""
    of = lambda path, kind: F.try_variant_get(F.try_parse_json(fields), f"$['{key}']{path}", kind)
    got, admitted = of("", "variant"), F.coalesce(of(".admitted", "boolean"), F.lit(False))
    state = F.when(got.isNull(), "missing").when(F.is_variant_null(got) | ~admitted, "withheld").otherwise("have")
    return F.struct(state.alias("state"), of(".value", "string").alias("value"), of(".check", "string").alias("by"))


def decided(*outcomes: Column) -> Column:
    """One failure is a mismatch, else one check left open leaves all open. Built on outcomes alone, so unused details are pruned."""
    has = lambda outcome: F.array_contains(F.array(*outcomes), outcome)
    return F.when(has("fail"), "mismatch").when(has("indeterminate"), "indeterminate").otherwise("matched")


def reconciled(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates: as ``candidates.chosen`` returns them. (doc_id, decision, record_id, variance_minor, variance_share, checks)."""
    c = F.col
    d = docs.join(candidates, "doc_id", "left")
    r = c("record")
    is_new = F.when(c("seen"), "fail").otherwise("pass")
    new = _check("document is new", is_new, F.when(c("seen"), "this document has already been reconciled").otherwise("no earlier reconciliation for these bytes"))
    none = _check("one record matches", F.lit("fail"), F.lit("no record matched by reference, or by vendor and amount"))
    many = c("matches") > 1
    is_one = F.when(many, "indeterminate").otherwise("pass")
    one = _check(
        "one record matches",
        is_one,
        F.when(many, _text(c("matches"), " records match equally well: ", c("references"))).otherwise(_text(r["reference"], " for ", r["vendor_name"])),
    )
    is_active = F.when(r["active"], "pass").otherwise("fail")
    active = _check("vendor is active", is_active, F.when(r["active"], _text(r["vendor_name"], " is active")).otherwise(_text(r["vendor_name"], " is marked inactive")))
    same = (c("currency_state") == "have") & (loose(c("currency")) == loose(r["currency"]))
    same = F.coalesce(same, F.lit(False))
    currency_fits = F.when(c("currency_state") != "have", "indeterminate").when(same, "pass").otherwise("fail")
    currency = _check(
        "currency agrees",
        currency_fits,
        F.when(c("currency_state") == "withheld", _text("the gate withheld the currency on ", c("currency_by")))
        .when(c("currency_state") == "missing", "the document states no currency")
        .when(same, _text("both ", r["currency"]))
        .otherwise(_text("document says ", c("currency"), ", record says ", r["currency"], ", and nothing here converts")),
    )
    comparable = same & (c("total_state") == "have")
    difference = F.when(comparable, exact(c("total")) - exact(r["amount_minor"]))
    near = within_tolerance(difference)
    amount_fits = F.when(~comparable, "indeterminate").when(near, "pass").otherwise("fail")
    outcomes = (is_new, is_one, is_active, currency_fits, amount_fits)
    amount = _check(
        "amount agrees",
        amount_fits,
        F.when(~same, "the currency does not agree, so the amounts are not comparable")
        .when(c("total_state") == "withheld", _text("the gate withheld the amount on ", c("total_by")))
        .when(c("total_state") == "missing", "the document states no total")
        .otherwise(_text("document ", c("total"), " against record ", r["amount_minor"], ", variance ", difference, " minor units")),
    )
    found = r.isNotNull()
    d = d.withColumn("checks", F.when(found, F.array(new, one, active, currency, amount)).otherwise(F.array(new, none)))
    decision = F.when(~found, "no-candidate").otherwise(decided(*outcomes))
    share = F.try_divide(difference.cast("double"), r["amount_minor"].cast("double"))
    return d.select("doc_id", decision.alias("decision"), r["record_id"].alias("record_id"), difference.cast("bigint").alias("variance_minor"), share.alias("variance_share"), "checks")
