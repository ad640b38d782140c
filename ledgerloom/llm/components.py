"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two joins and aggregations over the edges, which never outgrow the input's; nodes with many neighbours are
aggregated before they meet and joined on a key that skew handling can split. Rounds grow with the logarithm of the
longest path, and go on until the edges no longer change. Every round is a table in the shared folder, so lineage stays short;
the last round's is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import drop, stored

#: Rounds after which something must be wrong: 2**60 nodes on one path settle earlier.
MAX_ROUNDS = 120


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node among it and its neighbours."""
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these (edges run from larger to smaller)."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])


def components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long), any order, repeats and loops allowed. (id, component) of every node that has an edge to another: the
    smallest id it reaches. Components of a single node are left out.
    """
    e = edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    now = _signature(e)
    for _ in range(MAX_ROUNDS):
        if not now[0]:
            break
        old, e = e, stored(_small_star(_large_star(e)), "edges")
        before, now = now, _signature(e)
        drop(old)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
