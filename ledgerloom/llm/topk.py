"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates and queries are cut into hashed blocks; each (query block, candidate block) pair is one group of bounded size.
Within it every dimension has its list sorted by value. Sorted access goes down all lists (from the top for positive
query components, from the bottom for negative ones) to growing depths; each row met is scored in full at once
(random access). A query stops when the bound - the inner product of its components with the values at the
present depth - is below its kth best score, as no unseen row can reach it. The best of all blocks are ranked at the end.

Scores are integers. While every sum of a group is below 2**53 (checked), doubles hold them exactly. Beyond, doubles with a bound on
their error say which scores may be among the best k, and when to stop; these few scores are computed in whole numbers.

Defined results: vectors that are null or hold null or non-finite components, or a component whose 256-fold is beyond a double, take
no part; a vector is compared with those of its own length; ties go to the smaller vec_id; null vec_ids take no part; a row is nobody's
own candidate (equal vec_id); rows of a repeated vec_id are candidates each, and queries with a ranking each. Ranks follow the exact
scores; a score beyond a long is shown as the nearest long. No query, or no candidate: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import stored

K = 5
QUERY_EVERY = 50
CANDIDATE_BLOCK = 16384
QUERY_BLOCK = 2048
FIRST_DEPTH = 16


def quantised(v: Column) -> Column:
    """floor(256 x) of each component, as a double, which holds it exactly: from 2**53 on a double has no fraction."""
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    return F.transform(v, lambda x: whole(x.cast("double") * 256))


def finite(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad


def threshold_topk(ids: np.ndarray, c: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), each (queries, k): the k best candidates of each query, padded by -inf and -1."""
    n, d = c.shape
    m = len(q)
    top_s, top_i = np.full((m, k), -np.inf), np.full((m, k), -1, np.int64)
    if not n or not m:
        return top_s, top_i
    order = np.argsort(c, axis=0, kind="stable")  # each column: one dimension's list, ascending
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    seen = np.zeros(n, bool)
    live = np.arange(m)
    done, depth = 0, min(FIRST_DEPTH, n)
    while len(live):
        met = np.concatenate([order[done:depth].ravel(), order[n - depth : n - done].ravel()])
        new = np.unique(met[~seen[met]]) if d else np.flatnonzero(~seen)
        seen[new] = True
        for a in range(0, len(new), 2048):
            rows = new[a : a + 2048]
            s = q[live] @ c[rows].T
            s[q_ids[live][:, None] == ids[rows][None, :]] = -np.inf
            if s.shape[1] > k:  # all rows at the kth score or above stay, so that ties are cut by id below
                kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                keep = np.flatnonzero((s >= np.maximum(kth, top_s[live, k - 1])[:, None]).any(axis=0))
                rows, s = rows[keep], s[:, keep]
            both = np.concatenate([top_s[live], s], axis=1)
            both_ids = np.concatenate([top_i[live], np.broadcast_to(ids[rows], s.shape)], axis=1)
            at = np.lexsort((both_ids, -both), axis=1)[:, :k]
            top_s[live], top_i[live] = np.take_along_axis(both, at, 1), np.take_along_axis(both_ids, at, 1)
        if depth >= n or seen.all():
            break
        lists = np.arange(d)
        bound = up[live] @ c[order[n - depth], lists] + down[live] @ c[order[depth - 1], lists]
        live = live[~(bound < top_s[live, k - 1])]
        done, depth = depth, min(2 * depth, n)
    top_i[np.isneginf(top_s)] = -1
    return top_s, top_i


def exact_topk(ids: np.ndarray, c: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int = K) -> list[list[tuple[int, int]]]:
    """The k best (score, id) of each query, where sums are beyond 2**53: the same walk down the lists, in scaled doubles with an error bound.

    A row is scored in whole numbers only if its bounds let it be among the k best.
    """
    n, d = c.shape
    top: list[list[tuple[int, int]]] = [[] for _ in q]  # (-score, id), ascending
    scale = [2.0 ** max(int(np.frexp(np.abs(x).max(initial=0))[1]), 0) for x in (c, q)]
    cs, qs = (np.ldexp(x.astype(np.float64), -int(np.log2(s))) for x, s in zip((c, q), scale, strict=True))
    unit = int(scale[0]) * int(scale[1])
    error = (d + 4) * 2.0**-52 * (np.abs(qs) @ np.abs(cs).max(axis=0, initial=0)) if n else np.zeros(len(q))
    error += d * 2.0**-1000  # products too small for a double
    order = np.argsort(cs, axis=0, kind="stable")
    up, down = np.maximum(qs, 0), np.minimum(qs, 0)
    seen = np.zeros(n, bool)
    live = np.arange(len(q)) if n else np.zeros(0, np.int64)
    done, depth = 0, min(FIRST_DEPTH, n)

    def kth(i: int) -> float:
        """A lower bound of query i's kth best score, scaled."""
        return -np.inf if len(top[i]) < k else float(np.nextafter(_ratio(-top[i][-1][0], unit), -np.inf))

    while len(live):
        met = np.concatenate([order[done:depth].ravel(), order[n - depth : n - done].ravel()])
        new = np.unique(met[~seen[met]]) if d else np.flatnonzero(~seen)
        seen[new] = True
        for a in range(0, len(new), 2048):
            rows = new[a : a + 2048]
            s = qs[live] @ cs[rows].T
            for at, i in enumerate(live):
                may = np.flatnonzero(ids[rows] != q_ids[i])
                if len(may) > k:
                    floor = -np.partition(-s[at, may], k - 1)[k - 1] - 2 * error[i]
                    may = may[s[at, may] >= floor]
                may = may[s[at, may] + error[i] >= kth(i)]
                mine = [int(x) for x in q[i]]
                best = [(-sum(x * int(y) for x, y in zip(mine, c[r], strict=True)), int(ids[r])) for r in rows[may]]
                top[i] = sorted(top[i] + best)[:k]
        if depth >= n or seen.all():
            break
        lists = np.arange(d)
        bound = up[live] @ cs[order[n - depth], lists] + down[live] @ cs[order[depth - 1], lists] + error[live]
        live = live[[not b < kth(i) for b, i in zip(bound, live, strict=True)]]
        done, depth = depth, min(2 * depth, n)
    return [[(-s, i) for s, i in best] for best in top]


def _ratio(a: int, b: int) -> float:
    try:
        return a / b
    except OverflowError:
        return np.inf if a > 0 else -np.inf


_LONG = 2**63 - 1
_KEY_BITS = 2 * 1100


def _shown(score: int) -> tuple[int, bytes | None]:
    """A score as a long, and a key of fixed length that orders those which a long cannot tell apart."""
    if -_LONG < score < _LONG:
        return score, None
    return (_LONG if score > 0 else -_LONG - 1), (score + (1 << _KEY_BITS)).to_bytes(_KEY_BITS // 8 + 1, "big")


def topk(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """vectors: (vec_id, v: array of longs, or of doubles that are whole numbers). (query_id, rank, vec_id, score) of each query's k best other rows."""
    v = F.col("v")
    whole = F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.coalesce(F.abs(x.cast("double")) == float("inf"), F.lit(False))), F.lit(False))
    rows = vectors.filter(F.col("vec_id").isNotNull() & whole).select("vec_id", "v", F.size("v").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).collect()[0]
    blocks, q_blocks = max(1, -(-n["n"] // CANDIDATE_BLOCK)), max(1, -(-n["q"] // QUERY_BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda m, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(m)).cast("int")
    asking = stored(rows.filter("is_query").withColumn("row", F.monotonically_increasing_id()), "queries")
    c = rows.select("dim", every(q_blocks).alias("qb"), block(blocks, 1).alias("cb"), F.lit(-1).cast("long").alias("row"), "vec_id", "v")
    q = asking.select("dim", F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int").alias("qb"), every(blocks).alias("cb"), "row", "vec_id", "v")

    def search(group: pa.Table) -> pa.Table:
        row = group.column("row").to_numpy()
        asks = row >= 0
        ids = group.column("vec_id").to_numpy()
        v = group.column("v").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        big = np.abs(v.astype(np.float64)).max(initial=0)
        args = (ids[~asks], v[~asks], ids[asks], v[asks])
        if v.shape[1] == 0 or big < 2.0**53 / big / v.shape[1]:
            s, i = threshold_topk(args[0], args[1].astype(np.float64), args[2], args[3].astype(np.float64), k)
            has = ~np.isneginf(s)
            many = has.sum(axis=1)
            found = (np.repeat(row[asks], many), np.repeat(args[2], many), i[has], s[has].astype(np.int64), [None] * int(has.sum()))
        else:
            best = exact_topk(*args, k)
            shown = [_shown(s) for b in best for s, _ in b]
            many = [len(b) for b in best]
            found = (np.repeat(row[asks], many), np.repeat(args[2], many), [i for b in best for _, i in b], [s for s, _ in shown], [b for _, b in shown])
        kinds = {"row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "beyond": pa.binary()}
        return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), found, strict=True)})

    found = c.unionAll(q).groupBy("dim", "qb", "cb").applyInArrow(search, "row long, query_id long, vec_id long, score long, beyond binary")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(finite(F.col("embedding")))
    return topk(rows.select("vec_id", quantised(F.col("embedding")).alias("v")), F.col("vec_id") % QUERY_EVERY == 0)
