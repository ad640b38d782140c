"""Mixing sources to target weights along a time-varying curriculum.

Targets: every source has a weight; the sources share the total size by weight, none above ``MAX_REPEATS`` times its own
size, the excess reshared by weight among the rest (water-filling, by running sums over a range-sorted table of sources).

Positions: within a source documents follow each other in a hashed order, epoch after epoch, up to the target. A
copy's place in that order, as a share of the target, is the source's cumulative token demand; the demand is the integral
of the source's weight schedule (linear in training time), and inverting it gives the copy's training position. The mix
is range-sorted by position.

The hashed order is kept as sums of ``BUCKETS`` hash ranges of each source: a document's place is its range's start plus
its hash's share of the range. So no document order is ever computed in one task: placing is a map over documents
with the table of ranges, whose size depends on the number of sources alone. A document's hash is that of its id, text and source,
and of its number among rows equal in all three, so that repeated and null ids spread over the order like any others.

Defined results: null text has size 0; a null source is a source of its own, last in order; documents of size 0 and of sources
without words are taken by the same rule (0 words); rows are documents of their own, also when doc_ids repeat or are null;
rows equal in id, text and source share what is taken of them in any order. Very long texts are counted within
Spark's expressions. Sources of one weight class share a schedule. Extra columns pass through ``curriculum``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import free, numbered, running, stored

WEIGHTS = (5, 2, 1)
#: (weight at the start, weight at the end) of training, of each weight class: heavy sources rise, light ones fall.
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))
MAX_REPEATS = 3
BUCKETS = 1024
#: Rows of the range table up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def identity(doc_id: Column, text: Column, source: Column) -> Column:
    """A digest of what makes rows equal."""
    of = [F.coalesce(F.md5(x.cast("string")), F.lit("null")) for x in (doc_id, text, source)]
    return F.md5(F.concat_ws("/", *of))


def place(same: Column, nth: Column) -> Column:
    """A number from 0 to 2**32 - 1 fixed by a row's identity and its number among equal rows."""
    return F.conv(F.substring(F.md5(F.concat(same, F.lit("/"), nth.cast("string"))), 1, 8), 16, 10).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, most: float = MAX_REPEATS) -> DataFrame:
    """totals: (source, source_size). Adds nth (from 0, by code point, null last), weight and target."""
    t = running(totals.select("source", "source_size"), [F.col("source").asc_nulls_last()], nth=F.lit(1)).withColumn("nth", (F.col("nth") - 1).cast("long"))
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", most * F.col("source_size").cast("double"))
    t = running(t, [F.col("cap") / F.col("weight"), F.col("nth")], caps=F.col("cap"), weights=F.col("weight"))
    whole = t.agg(F.sum(F.col("source_size").cast("double")), F.sum("weight")).collect()[0]
    # with the smaller ratios capped the others share the rest; the level peaks where no more cap is met
    level = (F.lit(whole[0]) - (F.col("caps") - F.col("cap"))) / (F.lit(whole[1]) - F.col("weights") + F.col("weight"))
    peak = t.agg(F.max(level)).collect()[0][0]
    return t.select("source", "source_size", "nth", "weight", F.least(F.col("cap"), F.lit(peak).cast("double") * F.col("weight")).alias("target"))


def ranges(sizes: DataFrame, weights=WEIGHTS, most: float = MAX_REPEATS, buckets: int = BUCKETS) -> DataFrame:
    """sizes: (source, size, place). For each source and hash range: words in it and before it, and the source's figures."""
    sums = sizes.groupBy("source", F.floor(F.col("place") * buckets / 2.0**32).cast("int").alias("bucket")).agg(F.sum("size").alias("inside"))
    sums = stored(sums, "mix-ranges")
    of = targets(sums.groupBy("source").agg(F.sum("inside").alias("source_size")), weights, most)
    before = F.coalesce(F.sum("inside").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r, o = sums.withColumn("before", before).alias("r"), of.alias("o")
    joined = r.join(o, F.col("r.source").eqNullSafe(F.col("o.source")))
    return joined.select(F.col("r.source").alias("source"), "bucket", "inside", "before", "source_size", "nth", "target")


def placed(rows: DataFrame, table: DataFrame, most: int = MAX_REPEATS, buckets: int = BUCKETS) -> DataFrame:
    """rows: with source and _place. Adds _source_size, _target, _nth, _mid (the document's place in its source's order, in words) and _copies."""
    table = stored(table, "mix-table")
    small = table.count() <= BROADCAST_ROWS
    table = table.select(*[F.col(c).alias(f"_{c}") for c in table.columns])
    at = F.col("_place") * buckets / 2.0**32
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.floor(at).cast("int") == F.col("_bucket"))
    mid = F.col("_before") + F.col("_inside") * (at - F.floor(at))
    taken = [F.when(F.col("_mid") + k * F.col("_source_size") < F.col("_target"), 1).otherwise(0) for k in range(most)]
    rows = rows.join(F.broadcast(table) if small else table, on).withColumn("_mid", mid).withColumn("_copies", sum(taken[1:], taken[0]))
    return rows.drop("_source", "_bucket", "_before", "_inside", "_place")


def position(share: Column, nth: Column, schedules=SCHEDULES) -> Column:
    """Training time in [0, 1) at which a source has taken this share of its target.

    Demand with weight a + (b - a) t integrates to (a t + (b - a) t^2 / 2) / ((a + b) / 2); this is its inverse.
    """
    out = share
    for k, (a, b) in enumerate(schedules):
        if a != b:
            t = (F.sqrt(a * a + (b * b - a * a) * share) - a) / (b - a)
            out = F.when(nth % len(schedules) == k, t).otherwise(out)
    return out


def _sized(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, _same, _place) of every document, stored; and the identities of several rows."""
    same = identity(F.col("doc_id"), F.col("text"), F.col("source"))
    sizes = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size"), same.alias("_same")), "mix-sizes")
    again = stored(sizes.groupBy("_same").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_same"), "mix-repeats")
    return numbered(sizes, "_same", again, "_number").withColumn("_place", place(F.col("_same"), F.col("_number"))), again


def curriculum(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, most: int = MAX_REPEATS) -> DataFrame:
    """Every copy of a document that the mix takes, with its columns (but any of these names), ``mix_copy`` and ``mix_position``, range-sorted by position."""
    (same,) = free(docs, "_same")
    sizes, again = _sized(docs)
    table = ranges(sizes.select("source", "size", F.col("_place").alias("place")), weights, most)
    kept = docs.select(F.struct(*docs.columns).alias("kept"), "source", identity(F.col("doc_id"), F.col("text"), F.col("source")).alias("_same"))
    rows = numbered(kept, "_same", again, "_number")
    rows = rows.withColumn("_place", place(F.col("_same"), F.col("_number")))
    p = placed(rows, table, most).filter("_copies > 0")
    p = p.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    share = F.try_divide(F.col("_mid") + F.col("mix_copy") * F.col("_source_size"), F.col("_target"))
    of = [F.col("kept")[c].alias(c) for c in docs.columns if c not in ("mix_copy", "mix_position")]
    out = p.select(*of, "mix_copy", position(share, F.col("_nth"), schedules).alias("mix_position"), p["_same"].alias(same))
    return out.repartitionByRange(F.col("mix_position"), F.col(same)).sortWithinPartitions("mix_position", same).drop(same)


def taken(docs: DataFrame, weights=WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position of the first copy or null), range-sorted by that position."""
    sizes, _ = _sized(docs)
    sizes = stored(sizes.drop("_number"), "mix-places")
    p = placed(sizes, ranges(sizes.select("source", "size", F.col("_place").alias("place")), weights, most), most)
    at = F.when(F.col("_copies") > 0, position(F.col("_mid") / F.col("_target"), F.col("_nth")))
    out = p.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"), at.alias("position"), "_same")
    return out.repartitionByRange(F.col("position"), F.col("_same")).sortWithinPartitions("position", "_same").drop("_same")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CASES = " ".join(f"WHEN {k} THEN (sqrt({a * a}::DOUBLE + ({b * b - a * a})::DOUBLE * s) - {a}::DOUBLE) / ({b - a})::DOUBLE" for k, (a, b) in enumerate(SCHEDULES) if a != b)
OP9_SQL = f"""
WITH i AS (
  SELECT doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\\x20\\x09-\\x0D]+', 'x', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')), 0)::BIGINT AS size,
         md5(coalesce(md5(doc_id::VARCHAR), 'null') || '/' || coalesce(md5(text), 'null') || '/' || coalesce(md5(source), 'null')) AS same
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY same) - 1 AS number FROM i),
d AS (SELECT doc_id, source, size, CAST('0x' || substr(md5(same || '/' || number), 1, 8) AS BIGINT) * {BUCKETS} / 4294967296.0::DOUBLE AS spot FROM n),
b AS (SELECT source, floor(spot)::INT AS bucket, sum(size)::BIGINT AS inside FROM d GROUP BY ALL),
r AS (SELECT *, coalesce(sum(inside) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b),
s AS (
  SELECT source, source_size, nth, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(nth % 3 + 1)::INT] AS weight, {MAX_REPEATS}.0::DOUBLE * source_size AS cap
  FROM (SELECT source, sum(inside)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM b GROUP BY source)),
l AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, nth, least(cap, max(level) OVER () * weight) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.nth, t.target, r.before + r.inside * (d.spot - floor(d.spot)) AS mid
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND floor(d.spot)::INT = r.bucket JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, mid / target AS s, (mid < target)::INT + (mid + source_size < target)::INT + (mid + 2 * source_size < target)::INT AS copies FROM p)
SELECT doc_id, size, source_size, target, size * copies AS taken,
       CASE WHEN copies > 0 THEN CASE nth % 3 {_CASES} ELSE s END END AS position
FROM c
"""
