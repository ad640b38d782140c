"""Whether a document's amounts agree with each other.

values: wide, (doc_id, subtotal, tax, total bigint, tax_rate bigint per cent, lines decimal: the sum of line items), null
where a value is absent, of the wrong type or not bound to the page. An identity is judged only if all it needs is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact, truncated_quotient, within_tolerance

# The fields that identities touch, and identity names in the order in which they are judged.
FIELDS = ("subtotal", "tax", "total")
LINES, TOTAL, RATE = "line items sum to the subtotal", "subtotal + tax = total", "tax = subtotal x rate"


def _identity(name: str, fields: tuple[str, ...], difference: Column, detail: Column) -> Column:
    return F.when(
        difference.isNotNull(),
        F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, fields)).alias("fields"), within_tolerance(difference).alias("ok"), difference.cast("bigint").alias("difference"), detail.alias("detail")),
    )


def identities(rate: Column | None = None) -> Column:
    """Array of struct<name, fields, ok, difference, detail>. ``rate``: basis points that override tax_rate."""
    s, t, total = (exact(F.col(c)) for c in ("subtotal", "tax", "total"))
    bp = F.col("tax_rate") * 100 if rate is None else F.coalesce(rate, F.col("tax_rate") * 100)
    text = lambda label, d: F.concat(F.lit(f"{label} = "), d.cast("string"), F.lit(" minor units"))
    d1, d2 = exact(F.col("lines")) - s, s + t - total
    d3 = t - truncated_quotient(s * bp, F.lit(10000))
    return F.array_compact(
        F.array(
            _identity(LINES, ("subtotal",), d1, text("line items - subtotal", d1)),
            _identity(TOTAL, ("subtotal", "tax", "total"), d2, text("subtotal + tax - total", d2)),
            _identity(RATE, ("subtotal", "tax"), d3, F.concat(F.lit("tax - subtotal x "), bp.cast("string"), F.lit("bp = "), d3.cast("string"), F.lit(" minor units"))),
        )
    )


def checked(values: DataFrame, rate: Column | None = None) -> DataFrame:
    return values.withColumn("identities", identities(rate))


def field_checks() -> Column:
    """Array of struct<field, n, ok, identity> from the column ``identities``: how many touch each field, and the first failing one."""
    touching = lambda field: F.filter("identities", lambda i: F.array_contains(i["fields"], F.lit(field)))
    bad = lambda of: F.filter(of, lambda i: ~i["ok"])

    def of(field: str) -> Column:
        first = F.get(bad(touching(field)), F.lit(0))
        return F.struct(F.lit(field).alias("field"), F.size(touching(field)).alias("n"), first.isNull().alias("ok"), first["name"].alias("identity"))

    return F.array(*map(of, FIELDS))


def by_field(found: DataFrame) -> DataFrame:
    """(doc_id, field, ok, identity): the first failing identity of each field it touches, else that it passed."""
    rows = found.select("doc_id", F.inline(field_checks()))
    return rows.filter("n > 0").drop("n")


def runs(found: DataFrame) -> DataFrame:
    """(name, judged, failed): over how many documents each identity could be judged."""
    rows = found.select(F.explode("identities").alias("i"))
    return rows.groupBy("i.name").agg(F.count(F.lit(1)).alias("judged"), F.count_if(~F.col("i.ok")).alias("failed"))
