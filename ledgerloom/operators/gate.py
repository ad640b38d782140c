"""Admit or abstain on every field, with the check that decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_fixed

# Confidence floors by type, and what a wider binding adds.
FLOORS = (("string", 0.35), ("amount", 0.5), ("date", 0.4), ("integer", 0.5))
OTHER_FLOOR = 0.5
SPAN_PENALTY = 0.15

VERDICT = "struct<admitted:boolean,check:string,confidence_check:string,binding:string,arithmetic:string>"


def floor_of(kind: Column, status: Column, override: Column | None = None) -> Column:
    base = F.lit(OTHER_FLOOR)
    for t, x in FLOORS:
        base = F.when(kind == t, x).otherwise(base)
    if override is not None:
        base = F.coalesce(override, base)
    return base + F.when(status == "span", SPAN_PENALTY).otherwise(0.0)


def judge(value: Column, kind: Column, status: Column, source: Column, confidence: Column, arithmetic_ok: Column, floor: Column | None = None) -> Column:
    """VERDICT of one field: absent, binding, confidence and arithmetic are asked in this order."""
    exempt = F.coalesce(source == "text-layer", F.lit(False))
    low = F.coalesce(confidence < floor_of(kind, status, floor), F.lit(True))
    check = (
        F.when(value.isNull(), "absent")
        .when(status == "unbound", "binding")
        .when(~exempt & low, "confidence")
        .when(F.coalesce(~arithmetic_ok, F.lit(False)), "arithmetic")
    )
    passed = check.isNull()
    arithmetic = F.when(arithmetic_ok.isNull(), "not checked").when(arithmetic_ok, "passed").otherwise("failed")
    return F.struct(
        passed.alias("admitted"),
        check.alias("check"),
        F.when(passed, F.when(exempt, "not applicable").otherwise("passed")).alias("confidence_check"),
        F.when(passed, status).alias("binding"),
        F.when(passed, arithmetic).alias("arithmetic"),
    )


def reason(check: Column, status: Column, kind: Column, confidence: Column, unbound_reason: Column, identity: Column) -> Column:
    """The sentence that goes with a refusal."""
    low = F.concat(
        F.lit("read at "), to_fixed(confidence, 3), F.lit(", below the "), to_fixed(floor_of(kind, status), 2), F.lit(" floor for a "), kind, F.lit(" bound at "), status, F.lit(" width")
    )
    return (
        F.when(check == "absent", "the model reported no value for this field")
        .when(check == "binding", F.coalesce(unbound_reason, F.lit("value not found on the page")))
        .when((check == "confidence") & confidence.isNull(), "no confidence was reported for a recognised region")
        .when(check == "confidence", low)
        .when(check == "arithmetic", F.concat(F.lit("the document does not agree with itself: "), identity))
    )


def judged(fields: DataFrame, floor: Column | None = None) -> DataFrame:
    """fields: (doc_id, key, type, value, status, source, confidence, arithmetic_ok); adds ``verdict``."""
    c = F.col
    return fields.withColumn("verdict", judge(c("value"), c("type"), F.coalesce(c("status"), F.lit("unbound")), c("source"), c("confidence"), c("arithmetic_ok"), floor))


def summary(verdicts: DataFrame) -> DataFrame:
    """By document: admitted, abstained, admitted without a confidence to check, and abstentions by failing check."""
    v = F.col("verdict")
    by = [F.count_if(F.coalesce(v["check"] == k, F.lit(False))).alias(f"by_{k}") for k in ("absent", "binding", "confidence", "arithmetic")]
    exempt = F.coalesce(v["confidence_check"] == "not applicable", F.lit(False))
    return verdicts.groupBy("doc_id").agg(F.count_if(v["admitted"]).alias("admitted"), F.count_if(~v["admitted"]).alias("abstained"), F.count_if(exempt).alias("confidence_not_applicable"), *by)
