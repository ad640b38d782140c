"""Slot-bound plans: which actions are legal and which slots may fill their parameters.

slots: (run_id, seq, key, type, value, provenance), one row for each slot written; written once and in order of seq.
Actions are a short table of parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import format_minor
from ..functions.text import reference_key

# Provenances, and the actions of the reconciliation plan.
PROVENANCE = ("document-asserted", "source-attested", "host-computed")
ACTIONS = (
    ("lookup_record", "reference", "string", "document-asserted", "record.amount"),
    ("compute_variance", "documentAmount", "amount", "document-asserted", "variance"),
    ("compute_variance", "recordAmount", "amount", "source-attested", "variance"),
    ("report", "variance", "amount", "host-computed", None),
)


def actions(spark: SparkSession) -> DataFrame:
    """(action, param, type, provenance, produces)"""
    return spark.createDataFrame(list(ACTIONS), "action string, param string, type string, provenance string, produces string")


def admissible(slots: DataFrame, params: DataFrame) -> DataFrame:
    """(run_id, action, param, key, seq) of every slot that may fill a parameter; a null provenance accepts any."""
    p = params.select("action", "param", F.col("type").alias("t"), F.col("provenance").alias("p"))
    on = (F.col("type") == F.col("t")) & (F.col("p").isNull() | (F.col("provenance") == F.col("p")))
    return slots.join(F.broadcast(p), on).select("run_id", "action", "param", "key", "seq")


def legal(slots: DataFrame, params: DataFrame) -> DataFrame:
    """(run_id, action): every parameter has an admissible slot, and what it produces is not a slot yet."""
    need = params.groupBy("action").agg(F.countDistinct("param").alias("need"), F.first("produces", ignorenulls=True).alias("produces"))
    have = admissible(slots, params).groupBy("run_id", "action").agg(F.countDistinct("param").alias("have"))
    ready = have.join(F.broadcast(need), "action").filter("have = need")
    done = slots.select("run_id", F.col("key").alias("produces")).distinct()
    return ready.join(done, ["run_id", "produces"], "left_anti").select("run_id", "action")


def action_choices(legal_actions: DataFrame, order: tuple[str, ...] = ("lookup_record", "compute_variance", "report")) -> DataFrame:
    """(run_id, choices): the legal actions of a run as the enumeration of a JSON schema, in the plan's order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("action"))
    listed = legal_actions.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "action"))).alias("a"))
    return listed.select("run_id", F.to_json(F.struct(F.transform("a", lambda x: x["action"]).alias("enum"))).alias("choices"))


def reference_choices(slots: DataFrame, params: DataFrame) -> DataFrame:
    """(run_id, action, param, choices): admissible slots of each parameter, in the order they were written."""
    listed = admissible(slots, params).groupBy("run_id", "action", "param").agg(F.array_sort(F.collect_list(F.struct("seq", "key"))).alias("k"))
    return listed.select("run_id", "action", "param", F.transform("k", lambda x: x["key"]).alias("choices"))


def shown(kind: Column, value: Column) -> Column:
    return F.when(kind == "amount", format_minor(value.try_cast("decimal(38,0)"))).otherwise(value)


def rendered(slots: DataFrame) -> DataFrame:
    """(run_id, text): a line for each slot."""
    line = F.concat(F.col("key"), F.lit(" : "), F.col("type"), F.lit(" ("), F.col("provenance"), F.lit(") = "), shown(F.col("type"), F.col("value")))
    listed = slots.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    return listed.select("run_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def carried_out(slots: DataFrame, records: DataFrame, most_turns: int = 12) -> DataFrame:
    """Run the plan for all runs at once, a bounded number of rounds: look up, subtract, report.

    records: (reference_key, amount_minor). (run_id, variance, stop_reason): terminal, or no-legal-action where a slot is missing.
    """
    if most_turns < 3:
        return slots.select("run_id").distinct().select("run_id", F.lit(None).cast("bigint").alias("variance"), F.lit("turn-cap").alias("stop_reason"))
    asserted = slots.filter(F.col("provenance") == "document-asserted")
    first = lambda kind: F.min_by("value", F.when(F.col("type") == kind, F.col("seq")))
    run = asserted.groupBy("run_id").agg(first("string").alias("reference"), first("amount").alias("total"))
    ledger = records.groupBy("reference_key").agg(F.min_by("amount_minor", "record_id").alias("amount_minor"))
    found = run.withColumn("reference_key", reference_key(F.col("reference"))).join(ledger, "reference_key", "left")
    variance = (F.col("total").try_cast("bigint") - F.col("amount_minor")).alias("variance")
    return found.select("run_id", variance, F.when(F.col("total").isNull() | F.col("amount_minor").isNull(), "no-legal-action").otherwise("terminal").alias("stop_reason"))
