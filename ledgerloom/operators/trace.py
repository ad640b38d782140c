"""Hash-linked decision records.

records: (run_id, pos, body): body is the record's canonical JSON text without its head. head' = sha256(head + body).
A trace is short - one record for each stage of a run - so a run's records are folded in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest

#: What the first record is linked to is the digest of this text; pass the one that the chains to be checked began with.
GENESIS = "trace-genesis"

# The keys of a record that are linked over.
KEYS = ("action", "digest", "reads", "stage", "writes")


def _runs(records: DataFrame, *extra: str) -> DataFrame:
    return records.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "body", *extra))).alias("records"))


def _step(head, body):
    return digest(F.concat(head, body))


def chained(records: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """(run_id, root, heads): heads in order, the root being the last."""
    start = F.array(digest(F.lit(genesis)))
    heads = F.aggregate("records", start, lambda a, r: F.array_append(a, _step(F.element_at(a, -1), r["body"])))
    return _runs(records).select("run_id", heads.alias("h")).select("run_id", F.element_at("h", -1).alias("root"), F.slice("h", 2, F.size("h") - 1).alias("heads"))


def broken_at(records: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """records with their recorded ``head``. (run_id, ok, root, broken_at): position of the first record whose head does not follow."""
    state = F.struct(digest(F.lit(genesis)).alias("head"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("i"))

    def fold(s, r):
        right = _step(s["head"], r["body"]) == r["head"]
        bad = s["at"].isNull() & ~F.coalesce(right, F.lit(False))
        return F.struct(
            F.when(s["at"].isNull() & right, r["head"]).otherwise(s["head"]).alias("head"), F.when(bad, s["i"]).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i")
        )

    out = _runs(records, "head").select("run_id", F.aggregate("records", state, fold).alias("s"))
    return out.select("run_id", F.col("s.at").isNull().alias("ok"), F.col("s.head").alias("root"), F.col("s.at").alias("broken_at"))
